"""Queries on findings, chunks and chapters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionlake.operators import chunks as K
from captionlake.operators import render as R
from captionlake.operators import review as V
from captionlake.plans.captions import WORDS
from captionlake.sources import files as S
from captionlake.sources import fixtures as X

CHUNK, SPAN = 1500, 2500
SMALL_CHUNK, SMALL_SPAN = 300, 700


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.indexed(X.conversation_words(spark, sf_dir))


def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.low_confidence(_words(spark, sf_dir))
    return found.withColumn("confidence", F.round(F.col("confidence") * 100).cast("long")).withColumnRenamed("confidence", "percent")


def fallback_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every seventh turn the words take the times of the turn."""
    words, turns = _words(spark, sf_dir), X.conversation_segments(spark, sf_dir)
    spans = turns.select("transcript_id", "segment_index", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    some = (F.col("transcript_id") + F.col("segment_index")) % 7 == 0
    flat = words.join(spans, ["transcript_id", "segment_index"]).withColumn("start_ms", F.when(some, F.col("a")).otherwise(F.col("start_ms"))).withColumn("end_ms", F.when(some, F.col("b")).otherwise(F.col("end_ms")))
    return V.fallback_timing(flat, turns)


def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few words without a speaker, and a second speaker in every third turn."""
    percent = F.round(F.col("confidence") * 100)
    speaker = F.when(percent == 3, None).when((F.col("segment_index") % 3 == 0) & (percent > 90), F.lit("guest")).otherwise(F.col("speaker"))
    return V.speaker_turns(_words(spark, sf_dir).withColumn("speaker", speaker))


def term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), "text", F.lit(False).alias("authoritative"))
    found = V.term_candidates(_words(spark, sf_dir), V.terms(S.term_tokens(files)))
    return found.select("transcript_id", "candidate_index", "word_index", "observed", "proposed", F.round(F.col("score").cast("double"), 5).alias("score"))


#: Spoken in the middle of turns of the conversations.
SPOKEN = ["visit", "Example", ".com", "slash", "docs", "slash", "guide.", "dot", "html,"]
EVERY = 37


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("transcript_id", "segment_index")))
    at = F.col("place") % EVERY
    inside = (at < len(SPOKEN)) & (F.col("place") - at + len(SPOKEN) < F.col("n"))
    return words.withColumn("text", F.when(inside, F.get(F.array(*map(F.lit, SPOKEN)), at.cast("int"))).otherwise(F.regexp_replace("text", r"(?i)^[\s.]*(visit|open|at|on|website|url|link|www)\W*$", "-")))


def _spelt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of each page as words: of odd ids with dots before parts, of even ones with "dot" between them. Its transcript is -1 less the id."""
    i = F.col("page_id")
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.rtrim(F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1), F.lit("/"))

    def parts(name):
        joined = lambda p: F.when(i % 2 > 0, F.array(F.concat(F.lit("."), p))).otherwise(F.array(F.lit("dot"), p))
        return F.flatten(F.transform(F.split(name, r"\."), lambda p, n: F.when(n == 0, F.array(p)).otherwise(joined(p))))

    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    spelt = F.concat(F.array(F.lit("Please"), F.lit("visit")), parts(host), F.flatten(F.transform(segments, lambda s: F.concat(F.array(F.lit("slash")), parts(s)))), F.array(F.lit("today")))
    words = X.table(spark, sf_dir, "pages").select((-1 - i).alias("transcript_id"), F.posexplode(spelt).alias("n", "text"), ((i % 100).cast("float") / 100).cast("float").alias("confidence"))
    return words.select("transcript_id", F.col("n").cast("long").alias("word_index"), "text", "confidence")


def spoken_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in the conversations as they are, which hold none, and in those of all pages, spelt as one says them."""
    words = _words(spark, sf_dir).select("transcript_id", "word_index", "text", "confidence").union(_spelt_pages(spark, sf_dir))
    return V.spoken_urls(words).withColumn("confidence", F.round(F.col("confidence") * 100).cast("long")).withColumnRenamed("confidence", "percent")


def planted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses where one is laid over every few words and no other can stand, so that SQL knows them."""
    return V.spoken_urls(_spoken(spark, sf_dir)).withColumn("confidence", F.round(F.col("confidence") * 100).cast("long")).withColumnRenamed("confidence", "percent")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks so small that most turns are cut between words."""
    return K.chunked(X.conversation_segments(spark, sf_dir), SMALL_CHUNK)


def analysis_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.span_groups(chunks(spark, sf_dir), SMALL_SPAN)


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all turns; those longer than a chunk are cut between words."""
    return K.chunked(X.conversation_segments(spark, sf_dir), CHUNK)


def whole_analysis_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.span_groups(whole_chunks(spark, sf_dir), SPAN)


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as topics of a video for each user, at coarse starts so that some meet."""
    events = X.table(spark, sf_dir, "events")
    start = (F.col("event_id") % 50) * 1000
    topics = events.select(F.col("user_id").alias("transcript_id"), F.col("event_id").alias("topic_index"), F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type")).alias("title"), start.alias("start_ms"), (start + F.col("event_id") % 3).alias("end_ms"))
    return R.chapters(topics)


def chunk_sql(size: int) -> str:
    """Chunks of all turns: one longer than size is cut to pieces in a walk over its words, and each piece is a chunk."""
    return (
        WORDS
        + rf""",
    spans AS (SELECT transcript_id, segment_index, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM timed GROUP BY ALL),
    turns AS (SELECT transcript_id, segment_index, start_ms, end_ms, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM spans JOIN conversations ON conv_id = transcript_id AND turn = segment_index),
    parts AS (SELECT w.transcript_id, w.segment_index, w.place, w.text FROM timed w JOIN turns t ON t.transcript_id = w.transcript_id AND t.segment_index = w.segment_index WHERE length(t.text) > {size}),
    cut AS (
        SELECT transcript_id, segment_index, place, text, 1 AS p, length(text) AS len FROM parts WHERE place = 0
        UNION ALL
        SELECT r.transcript_id, r.segment_index, r.place, r.text, CASE WHEN len + 1 + length(r.text) > {size} THEN p + 1 ELSE p END, CASE WHEN len + 1 + length(r.text) > {size} THEN length(r.text) ELSE len + 1 + length(r.text) END
        FROM cut k JOIN parts r ON r.transcript_id = k.transcript_id AND r.segment_index = k.segment_index AND r.place = k.place + 1),
    pieces AS (SELECT transcript_id, segment_index, p, string_agg(text, ' ' ORDER BY place) AS text FROM cut GROUP BY ALL),
    units AS (
        SELECT transcript_id, segment_index, 0 AS p, start_ms, end_ms, text FROM turns WHERE length(text) <= {size}
        UNION ALL
        SELECT transcript_id, segment_index, p, start_ms, end_ms, c.text FROM pieces c JOIN spans USING (transcript_id, segment_index)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY segment_index, p) AS n, p > 0 AS piece, p = 0 AND regexp_matches(text, '[.!?]$') AS s FROM units),
    walk AS (
        SELECT transcript_id, n, start_ms, end_ms, text, 1 AS c, length(text) AS len, piece OR (s AND length(text) >= {size // 2}) AS closed FROM ranked WHERE n = 1
        UNION ALL
        SELECT r.transcript_id, r.n, r.start_ms, r.end_ms, r.text, CASE WHEN alone THEN c + 1 ELSE c END, CASE WHEN alone THEN length(r.text) ELSE len + 1 + length(r.text) END,
               r.piece OR (r.s AND CASE WHEN alone THEN length(r.text) ELSE len + 1 + length(r.text) END >= {size // 2})
        FROM (SELECT k.*, r AS r, closed OR r.piece OR len + 1 + length(r.text) > {size} OR (r.s AND len >= {size // 2}) AS alone FROM walk k JOIN ranked r ON r.transcript_id = k.transcript_id AND r.n = k.n + 1)),
    chunks AS (SELECT transcript_id, (c - 1)::BIGINT AS chunk_index, arg_min(start_ms, n) AS start_ms, arg_max(end_ms, n) AS end_ms, string_agg(text, ' ' ORDER BY n) AS text FROM walk GROUP BY transcript_id, c)"""
    )


def group_sql(size: int) -> str:
    """The groups of chunks."""
    return f"""g AS (
            SELECT transcript_id, chunk_index, length(text) AS chars, 0::BIGINT AS grp FROM chunks WHERE chunk_index = 0
            UNION ALL
            SELECT c.transcript_id, c.chunk_index, CASE WHEN chars + length(c.text) > {size} THEN length(c.text) ELSE chars + length(c.text) END, CASE WHEN chars + length(c.text) > {size} THEN grp + 1 ELSE grp END
            FROM g JOIN chunks c ON c.transcript_id = g.transcript_id AND c.chunk_index = g.chunk_index + 1)
        SELECT transcript_id, chunk_index, grp AS "group" FROM g"""


_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
_KEY = "translate(regexp_replace({}, '[^0-9A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_EDGE = "'\"''`()[]{}<>,;:'"

QUERIES = {f.__name__: f for f in (low_confidence, fallback_timing, speaker_turns, term_candidates, spoken_urls, planted_urls, chunks, analysis_spans, whole_chunks, whole_analysis_spans, chapters)}
SQL = {
    "low_confidence": f"WITH {WORDS} SELECT transcript_id, word_index, text, percent, start_ms, end_ms FROM timed WHERE percent < 75",
    "fallback_timing": f"""WITH {WORDS}, b AS (SELECT *, min(start_ms) OVER s AS a, max(end_ms) OVER s AS b, count(*) OVER s AS n FROM timed WINDOW s AS (PARTITION BY transcript_id, segment_index))
        SELECT transcript_id, word_index, text, a AS start_ms, b AS end_ms FROM b WHERE n > 1 AND (transcript_id + segment_index) % 7 = 0""",
    "speaker_turns": f"""WITH {WORDS}, s AS (SELECT transcript_id, segment_index, CASE WHEN percent = 3 THEN NULL WHEN segment_index % 3 = 0 AND percent > 90 THEN 'guest' ELSE speaker END AS speaker FROM timed)
        SELECT transcript_id, segment_index, array_to_string(list_sort(list(DISTINCT speaker) FILTER (speaker IS NOT NULL)), ',') AS speakers, bool_or(speaker IS NULL) AS has_unassigned_words
        FROM s GROUP BY ALL HAVING count(DISTINCT speaker) > 1 OR (count(speaker) > 0 AND bool_or(speaker IS NULL))""",
    "term_candidates": f"""WITH {WORDS},
        tok AS (SELECT item_id::VARCHAR AS path, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS raw, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1) AS place FROM benchmark),
        tk AS (SELECT path, place, trim(raw, {_EDGE}) AS token FROM tok),
        tt AS (SELECT *, {_KEY.format('token')} AS key FROM tk WHERE regexp_matches(token, '[._\\p{{Lu}}]') AND strlen(token) >= 3),
        terms AS (SELECT key, arg_min(token, (path, place)) AS display, count(*) AS n FROM tt WHERE length(key) >= 3 GROUP BY key),
        obs AS (SELECT *, trim(text, {_PUNCT}) AS o, regexp_matches(text, '[._/]') AS code FROM timed),
        ok AS (SELECT *, {_KEY.format('o')} AS k FROM obs WHERE percent < 75 OR (code AND percent < 85)),
        u AS (SELECT DISTINCT o, k, code FROM ok WHERE length(k) >= 4),
        forms AS (SELECT key, display, n, key AS form, false AS part FROM terms UNION ALL SELECT key, display, n, unnest(list_filter(regexp_split_to_array(display, '[^0-9A-Za-z]'), lambda x: x <> '')), true FROM terms),
        sc AS (SELECT o, code, key, display, n, max((1::FLOAT - (levenshtein(k, form)::DOUBLE / greatest(length(k), length(form)))::FLOAT)::FLOAT) AS score FROM u JOIN forms ON (code OR NOT part) GROUP BY ALL),
        best AS (SELECT * FROM sc WHERE score >= CASE WHEN code THEN 0.70::FLOAT ELSE 0.82::FLOAT END QUALIFY row_number() OVER (PARTITION BY o, code ORDER BY score DESC, n DESC, key, display) = 1)
        SELECT transcript_id, word_index AS candidate_index, word_index, text AS observed, display AS proposed, round(score::DOUBLE, 5) AS score
        FROM ok JOIN best USING (o, code) WHERE length(k) >= 4 AND n >= 2 AND k <> key""",
    "spoken_urls": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '/') AS path, CASE WHEN page_id % 2 > 0 THEN ' .' ELSE ' dot ' END AS dot FROM pages)
        SELECT -1 - page_id AS transcript_id, 2::BIGINT AS word_index, replace(host, '.', dot) || CASE WHEN path <> '' THEN ' slash ' || replace(replace(path, '.', dot), '/', ' slash ') ELSE '' END AS observed,
               lower(host) || CASE WHEN path <> '' THEN '/' || path ELSE '' END AS proposed, page_id % 100 AS percent FROM p""",
    "planted_urls": f"""WITH {WORDS}, n AS (SELECT *, count(*) OVER (PARTITION BY transcript_id, segment_index) AS n FROM timed)
        SELECT transcript_id, word_index + 1 AS word_index, '{" ".join(SPOKEN[1:])}' AS observed, 'example.com/docs/guide.html' AS proposed, (SELECT min(m.percent) FROM n m WHERE m.transcript_id = n.transcript_id AND m.word_index BETWEEN n.word_index + 1 AND n.word_index + {len(SPOKEN) - 1}) AS percent
        FROM n WHERE place % {EVERY} = 0 AND place + {len(SPOKEN)} < n""",
    "chunks": f"WITH RECURSIVE {chunk_sql(SMALL_CHUNK)} SELECT * FROM chunks",
    "analysis_spans": f"WITH RECURSIVE {chunk_sql(SMALL_CHUNK)}, {group_sql(SMALL_SPAN)}",
    "whole_chunks": f"WITH RECURSIVE {chunk_sql(CHUNK)} SELECT * FROM chunks",
    "whole_analysis_spans": f"WITH RECURSIVE {chunk_sql(CHUNK)}, {group_sql(SPAN)}",
    "chapters": """SELECT user_id AS transcript_id, (event_id % 50) * 1000 AS start_ms, event_type AS title FROM events WHERE event_id % 9 <> 0 AND event_id % 3 > 0
        QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY event_id) = 1""",
}
