"""Queries on readers, renderings of single values, replies and prompts, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.functions import text as X_
from captionlake.operators import attest as A
from captionlake.operators import captions as C
from captionlake.operators import providers as P
from captionlake.operators import render as R
from captionlake.operators import review as V
from captionlake.plans.captions import WORDS
from captionlake.sources import files as S
from captionlake.sources import fixtures as X
from captionlake.sources import transcripts as T


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())


# -- readers -----------------------------------------------------------------------------------


def worker_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a worker's segments: of every third the words have no times, of every fourth there are none but the text."""
    place, turn = F.col("place"), F.col("turn")
    spoken = _turns(spark, sf_dir).select("conv_id", "turn", "text", X_.words_of(F.col("text")).alias("list"))
    begin = turn * 1000 + F.lit(0.25)
    own = F.transform("list", lambda w, n: F.struct(F.concat(F.lit(" "), w).alias("word"), F.when(turn % 3 > 0, begin + n / 8).alias("start"), F.when(turn % 3 > 0, begin + n / 8 + 0.0625).alias("end"), (n / 1024).alias("probability")))
    segment = F.struct(turn.alias("id"), begin.alias("start"), (begin + 500).alias("end"), "text", F.when(turn % 4 > 0, own).alias("words"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", segment.alias("s")))), lambda x: x["s"])
    raw = spoken.groupBy("conv_id").agg(listed.alias("segments"))
    json = F.to_json(F.struct(F.when(F.col("conv_id") % 10 == 9, 2).otherwise(1).alias("version"), F.when(F.col("conv_id") % 2 == 0, "en").alias("language"), F.lit(1.5).alias("duration"), "segments"))
    read = T.worker_transcripts(raw.select(F.col("conv_id").alias("transcript_id"), json.alias("json")))
    words = T.words(read.filter(F.col("error").isNull()))
    return words.select("transcript_id", "segment_index", "word_index", "text", "start_ms", "end_ms", F.round(F.col("confidence").cast("double"), 6).alias("confidence")).join(read.select("transcript_id", "language", "duration_ms"), "transcript_id")


def transcript_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as transcript files and read back; every eleventh has a range of words beyond its end."""
    words = X.indexed(X.conversation_words(spark, sf_dir))
    word = F.struct("word_index", F.struct("text", "start_ms", "end_ms", "confidence", "speaker").alias("w"))
    every = words.groupBy("transcript_id").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).alias("words"))
    span = words.groupBy("transcript_id", "segment_index").agg(F.min("word_index").alias("a"), (F.max("word_index") + 1).alias("b"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    segment = F.struct("segment_index", F.struct("start_ms", "end_ms", F.lit("t").alias("text"), F.col("a").cast("int").alias("word_start"), (F.col("b") + F.when(F.col("transcript_id") % 11 == 0, 1_000_000).otherwise(0)).cast("int").alias("word_end")).alias("s"))
    segments = span.groupBy("transcript_id").agg(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["s"]).alias("segments"))
    made = every.join(segments, "transcript_id").select("transcript_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("en").alias("language"), F.lit(0).alias("duration_ms"), "words", "segments")).alias("json"))
    read = T.transcript_files(made)
    good = T.words(read.filter(F.col("error").isNull())).select("transcript_id", "word_index", "text", "start_ms", "end_ms", "speaker", F.lit(None).cast("string").alias("error"))
    none = [F.lit(-1).cast("long").alias(c) for c in ("word_index", "start_ms", "end_ms")]
    return good.unionByName(read.filter(F.col("error").isNotNull()).select("transcript_id", *none, "error"), allowMissingColumns=True)


def probed_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as probed files: times as strings, some negative or no number, and one to three streams."""
    i = F.col("doc_id")
    stream = lambda n: F.struct(n.alias("index"), F.when((n + i) % 3 == 0, "video").otherwise("audio").alias("codec_type"))
    streams = F.transform(F.sequence(F.lit(0), (i % 3).cast("int")), stream)
    time = F.when(i % 7 == 0, "-1.5").when(i % 11 == 0, "N/A").when(i % 13 == 0, None).otherwise(F.concat(F.col("n_chars").cast("string"), F.lit("."), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("5")))
    json = F.to_json(F.struct(streams.alias("streams"), F.struct(F.lit("mov").alias("format_name"), time.alias("duration")).alias("format")))
    found = T.media(X.table(spark, sf_dir, "documents").select(i.cast("string").alias("path"), json.alias("json")))
    return found.select("path", F.coalesce("duration_ms", F.lit(-1).cast("long")).alias("duration_ms"), F.size("audio").cast("long").alias("audio"), F.size("video").cast("long").alias("video"))


def page_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each page: a comment, its address as a rule, a deletion, and two lines that are no rules."""
    i = F.col("page_id").cast("string")
    text = F.concat(F.lit("# notes\n\n  "), "url", F.lit(" -> page "), i, F.lit("\r\nplain "), i, F.lit("\n-> nothing "), i, F.lit("\ngone "), i, F.lit(" ->\n\ta->b -> c -> d"))
    return S.manifest_rules(X.table(spark, sf_dir, "pages").select(F.concat(F.lit("m"), i).alias("manifest"), (F.col("page_id") % 3).alias("scope_rank"), text.alias("text")))


def contributing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contributing(page_manifests(spark, sf_dir)).groupBy("manifest").agg(F.count(F.lit(1)).alias("n"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of normalised files; of every fifth the text is blank."""
    text = F.when(F.col("turn") % 5 == 4, " \n").otherwise(F.col("text"))
    chunk = F.struct("turn", F.struct(F.col("turn").alias("start_ms"), (F.col("turn") + 1).alias("end_ms"), text.alias("text")).alias("c"))
    made = _turns(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["c"]).alias("chunks"))
    raw = made.select(F.col("conv_id").alias("transcript_id"), F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("en").alias("language"), "chunks")).alias("json"))
    return R.chunk_text(T.chunks(T.normalized_files(raw)))


# -- analyses, replies, prompts -------------------------------------------------------------------


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as an analysis: turns are topics, some without a title or time, words of users its points, roles its keywords."""
    topic = F.struct(
        (F.floor(F.col("turn") / 2) * 61_000).alias("start_ms"), (F.floor(F.col("turn") / 2) * 61_000 + F.col("turn") % 3).alias("end_ms"),
        F.when(F.col("turn") % 5 == 3, " ").otherwise(F.concat("role", F.lit(" "), F.col("turn").cast("string"))).alias("title"),
    )
    row = F.struct("turn", topic.alias("t"), F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" "), "text", F.lit(" "))).alias("p"), F.concat("role", F.lit(" of "), F.col("turn").cast("string")).alias("k"))
    turns = _turns(spark, sf_dir).filter("length(trim(text)) > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    pick = lambda f: F.transform("r", lambda x: x[f])
    return turns.select(
        F.col("conv_id").alias("transcript_id"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), F.concat(F.lit(" "), F.size("r").cast("string"), F.lit(" turns\n")).alias("summary"),
        pick("t").alias("topics"), F.filter(pick("p"), lambda p: p.isNotNull()).alias("key_points"), F.when(F.col("conv_id") % 3 > 0, pick("k")).otherwise(F.array().cast("array<string>")).alias("keywords"),
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary(_analyses(spark, sf_dir))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.description(_analyses(spark, sf_dir))


def read_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a fence, with prose around, with braces in strings, cut short, and without an object."""
    i = F.col("doc_id")
    body = F.to_json(F.struct(F.lit(7).alias("schema_version"), F.when(i % 2 == 0, "").otherwise("xx").alias("language"), F.concat(F.lit("T } \" { "), i.cast("string")).alias("title"), F.col("text").alias("summary")))
    reply = (
        F.when(i % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 5 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" {\"title\": \"second\"}")))
        .when(i % 5 == 2, F.concat(F.lit("x "), F.expr("substring(body, 1, length(body) - 1)"))).when(i % 5 == 3, F.lit("no object at all")).otherwise(F.col("body"))
    )
    docs = X.table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).withColumn("body", body)
    read = P.read_analysis(docs.select(i.alias("transcript_id"), F.col("lang").alias("language"), reply.alias("reply")))
    return read.select("transcript_id", F.col("schema_version").cast("long").alias("schema_version"), "language", "title", F.sha2("summary", 256).alias("summary"), "error")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.sha2(P.control_prompt(F.col("text"), "formal", "list", "lecture"), 256).alias("prompt"))


def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.conversation_segments(spark, sf_dir)
    return words.select("transcript_id", "segment_index", F.sha2(X_.span_text(F.col("start_ms"), F.col("end_ms"), F.col("text")), 256).alias("line"))


# -- single values -------------------------------------------------------------------------------


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as numbers and as strings, to milliseconds and to words."""
    seconds = F.when(F.col("event_id") % 5 == 0, -F.col("value")).otherwise(F.col("value"))
    spelt = F.concat(F.when(F.col("event_id") % 5 == 0, "-").otherwise(""), (F.col("event_id") * 37).cast("string"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.when(F.col("event_id") % 7 == 0, "s").otherwise(""))
    ms = F.col("event_id") * 937
    return X.table(spark, sf_dir, "events").select("event_id", X_.seconds_to_ms(seconds).alias("ms"), F.coalesce(X_.parse_seconds(spelt), F.lit(-1).cast("long")).alias("parsed_ms"), X_.human_duration(ms).alias("human"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages with credentials, queries, ports, as local ones, and as no addresses."""
    i = F.col("page_id")
    url = (
        F.when(i % 6 == 0, F.concat("url", F.lit("/?q=1#top"))).when(i % 6 == 1, F.regexp_replace("url", "^([a-z]+)://", r"$1://me:secret@")).when(i % 6 == 2, F.concat(F.lit("http://LOCALHOST:"), i.cast("string"), F.lit("/v1//")))
        .when(i % 6 == 3, F.concat(F.lit("http://127.0.0."), (i % 250).cast("string"), F.lit("/a"))).when(i % 6 == 4, F.concat(F.lit("https://[::1]:8/"), i.cast("string"))).otherwise(F.concat(F.lit("host/"), i.cast("string")))
    )
    return X.table(spark, sf_dir, "pages").select("page_id", X_.clean_endpoint(url).alias("endpoint"), X_.is_remote(url).alias("remote"))


def accepted_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = F.concat("text", F.lit(" site .com / a .b"), F.when(F.col("turn") % 2 == 0, "?!.").otherwise(""))
    forms = V.accept_forms(observed, F.col("turn") % 3 == 0)
    return _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(forms).alias("n", "form")).select("conv_id", "turn", F.col("n").cast("long").alias("n"), F.sha2("form", 256).alias("form"))


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as lines of 60 characters; those of two lines are balanced."""
    text = X_.trim_space(F.regexp_replace("text", r"\s+", " "))
    return X.table(spark, sf_dir, "benchmark").select("item_id", C.broken_lines(text, C.Policy(2, 60, 6000)).alias("lines"))


def memo_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text and language no remembered result has (those of every third id are remembered), each key once."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id", A.memo_key(text=F.col("text"), lang=F.col("lang")).alias("key"))
    known, fresh = A.memo_split(docs.select("key"), docs.filter("doc_id % 3 = 0").select("key", F.lit("v").alias("value")).distinct())
    return known.groupBy(F.lit("known").alias("kind")).agg(F.count(F.lit(1)).alias("n")).union(fresh.groupBy(F.lit("fresh").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


_TRIM = "regexp_replace({}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"
_ANALYSES = r"""
    a AS (SELECT conv_id, turn, role, text, turn // 2 * 61000 AS s, turn // 2 * 61000 + turn % 3 AS e, CASE WHEN turn % 5 = 3 THEN ' ' ELSE role || ' ' || turn END AS title FROM conversations WHERE length(trim(text)) > 0),
    head AS (SELECT conv_id, '# Talk ' || conv_id || chr(10) || chr(10) || count(*) || ' turns' || chr(10) AS head,
                    coalesce(chr(10) || '## Key points' || chr(10) || string_agg('- ' || regexp_replace(text, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') || chr(10), '' ORDER BY turn) FILTER (turn % 4 = 1), '') AS points,
                    CASE WHEN conv_id % 3 > 0 THEN chr(10) || string_agg('#' || role || 'of' || turn, ' ' ORDER BY turn) || chr(10) ELSE '' END AS tags FROM a GROUP BY conv_id),
    marks AS (SELECT * FROM a WHERE trim(title) <> '' AND s < e QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY turn) = 1),
    chaps AS (SELECT conv_id, string_agg('- ' || printf('%02d:%02d', s // 60000, s // 1000 % 60) || ' ' || title || chr(10), '' ORDER BY s) AS chapters FROM marks GROUP BY conv_id)"""
_TEXTS = "t AS (SELECT *, doc_id % 5 AS k FROM documents WHERE text IS NOT NULL)"

QUERIES = {f.__name__: f for f in (worker_words, transcript_words, probed_media, page_manifests, contributing_rules, normalized_text, summaries, descriptions, read_replies, prompts, span_lines, durations, endpoints, accepted_forms, wrapped_lines, memo_misses)}
SQL = {
    "worker_words": f"""WITH {WORDS}, w AS (
            SELECT transcript_id, segment_index, word_index, place, text, segment_index % 4 > 0 AS listed, segment_index % 4 > 0 AND segment_index % 3 > 0 AS clocked FROM timed WHERE transcript_id % 10 <> 9)
        SELECT transcript_id, segment_index, word_index, text, segment_index * 1000000 + 250 + CASE WHEN clocked THEN place * 125 ELSE 0 END AS start_ms,
               CASE WHEN clocked THEN round(segment_index * 1000000 + 250 + place * 125 + 62.5)::BIGINT ELSE segment_index * 1000000 + 500250 END AS end_ms,
               CASE WHEN listed THEN round((place / 1024.0)::FLOAT::DOUBLE, 6) END AS confidence, CASE WHEN transcript_id % 2 = 0 THEN 'en' ELSE 'unknown' END AS language, 1500::BIGINT AS duration_ms FROM w""",
    "transcript_words": f"""WITH {WORDS} SELECT transcript_id, word_index, text, start_ms, end_ms, speaker, NULL::VARCHAR AS error FROM timed WHERE transcript_id % 11 <> 0
        UNION ALL SELECT DISTINCT transcript_id, -1, NULL, -1, -1, NULL, 'a segment''s words are out of range' FROM timed WHERE transcript_id % 11 = 0""",
    "probed_media": """SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 > 0 AND doc_id % 11 > 0 AND doc_id % 13 > 0 THEN round((n_chars || '.' || lpad((doc_id % 1000)::VARCHAR, 3, '0') || '5')::DOUBLE * 1000)::BIGINT ELSE -1 END AS duration_ms,
               len(list_filter(range(0, doc_id % 3 + 1), lambda n: (n + doc_id) % 3 <> 0)) AS audio, len(list_filter(range(0, doc_id % 3 + 1), lambda n: (n + doc_id) % 3 = 0)) AS video FROM documents""",
    "page_manifests": f"""SELECT 'm' || page_id AS manifest, page_id % 3 AS scope_rank, x.i AS rule_index, x.f AS find, x.r AS replace, x.l AS line, x.e AS error FROM (SELECT page_id, unnest([
               {{'i': 0::BIGINT, 'f': {_TRIM.format("url")}, 'r': 'page ' || page_id, 'l': 3::BIGINT, 'e': NULL::VARCHAR}},
               {{'i': 1::BIGINT, 'f': NULL, 'r': NULL, 'l': 4::BIGINT, 'e': 'no separator'}}, {{'i': 2::BIGINT, 'f': NULL, 'r': NULL, 'l': 5::BIGINT, 'e': 'nothing to find'}},
               {{'i': 3::BIGINT, 'f': 'gone ' || page_id, 'r': '', 'l': 6::BIGINT, 'e': NULL}}, {{'i': 4::BIGINT, 'f': 'a->b', 'r': 'c -> d', 'l': 7::BIGINT, 'e': NULL}}]) AS x FROM pages)""",
    "contributing_rules": "SELECT 'm' || page_id AS manifest, 3::BIGINT AS n FROM pages",
    "normalized_text": f"""SELECT conv_id AS transcript_id, coalesce(string_agg({_TRIM.format("text")}, chr(10) || chr(10) ORDER BY turn) FILTER (turn % 5 <> 4 AND {_TRIM.format("text")} <> ''), '') || chr(10) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""",
    "summaries": f"WITH {_ANALYSES} SELECT conv_id AS transcript_id, head || points AS markdown FROM head",
    "descriptions": f"WITH {_ANALYSES} SELECT conv_id AS transcript_id, head || tags || chr(10) || '## Chapters' || chr(10) || chr(10) || coalesce(chapters, '') || points AS markdown FROM head LEFT JOIN chaps USING (conv_id)",
    "read_replies": f"""WITH {_TEXTS} SELECT doc_id AS transcript_id, 1::BIGINT AS schema_version, CASE WHEN k IN (2, 3) OR doc_id % 2 = 0 THEN lang ELSE 'xx' END AS language, CASE WHEN k NOT IN (2, 3) THEN 'T }} " {{ ' || doc_id END AS title,
               sha256(CASE WHEN k NOT IN (2, 3) THEN text ELSE '' END) AS summary, CASE WHEN k IN (2, 3) THEN 'no analysis in the reply' END AS error FROM t""",
    "prompts": "SELECT conv_id, turn, sha256('[Styling: formal] [Structure: list] [Context: lecture]' || chr(10) || text) AS prompt FROM conversations WHERE text IS NOT NULL",
    "span_lines": f"""WITH {WORDS}, s AS (SELECT transcript_id, segment_index, min(start_ms) AS a, max(end_ms) AS b FROM timed GROUP BY ALL)
        SELECT transcript_id, segment_index, sha256(printf('[%08.3fs - %08.3fs] ', a / 1000.0, b / 1000.0) || text) AS line FROM s JOIN conversations ON conv_id = transcript_id AND turn = segment_index""",
    "durations": """SELECT event_id, CASE WHEN event_id % 5 = 0 OR value <= 0 OR value IS NULL THEN 0 ELSE round(value * 1000)::BIGINT END AS ms,
               CASE WHEN event_id % 7 > 0 AND (event_id % 5 > 0 OR event_id = 0) THEN event_id * 37000 + event_id % 1000 ELSE -1 END AS parsed_ms,
               CASE WHEN event_id * 937 >= 60000 THEN (event_id * 937 // 60000) || 'm ' || (event_id * 937 // 1000 % 60) || 's' WHEN event_id * 937 >= 1000 THEN (event_id * 937 // 1000) || '.' || (event_id * 937 % 1000 // 100) || 's' ELSE (event_id * 937) || 'ms' END AS human FROM events""",
    "endpoints": """WITH u AS (SELECT page_id, page_id % 6 AS k, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)', ['a', 'b', 'c']) AS p FROM pages)
        SELECT page_id, CASE k WHEN 0 THEN lower(p.a) || '://' || lower(p.b) || regexp_replace(p.c || CASE WHEN p.a || '://' || p.b || p.c = (SELECT url FROM pages q WHERE q.page_id = u.page_id) THEN '/' ELSE '' END, '/+$', '') WHEN 1 THEN lower(p.a) || '://' || lower(p.b) || regexp_replace(p.c, '/+$', '')
                    WHEN 2 THEN 'http://localhost:' || page_id || '/v1' WHEN 3 THEN 'http://127.0.0.' || page_id % 250 || '/a' WHEN 4 THEN 'https://[::1]:8/' || page_id ELSE '<invalid-url>' END AS endpoint, k IN (0, 1, 5) AS remote FROM u""",
    "accepted_forms": """WITH f AS (SELECT conv_id, turn, regexp_replace(text || ' site .com / a .b', '^[\\s\\x{A0}]+', '') AS form FROM conversations WHERE text IS NOT NULL)
        SELECT conv_id, turn, 0::BIGINT AS n, sha256(form) AS form FROM f UNION ALL SELECT conv_id, turn, 1, sha256(replace(replace(form, ' .', '.'), ' /', '/')) FROM f WHERE turn % 3 = 0""",
    "wrapped_lines": r"""WITH RECURSIVE b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM benchmark),
        w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS n FROM b),
        walk AS (SELECT item_id, n, w, 1 AS l, length(w) AS len FROM w WHERE n = 1
                 UNION ALL SELECT x.item_id, x.n, x.w, CASE WHEN len + 1 + length(x.w) <= 60 THEN l ELSE l + 1 END, CASE WHEN len + 1 + length(x.w) <= 60 THEN len + 1 + length(x.w) ELSE length(x.w) END
                 FROM walk k JOIN w x ON x.item_id = k.item_id AND x.n = k.n + 1),
        lines AS (SELECT item_id, l, string_agg(w, ' ' ORDER BY n) AS line, list(w ORDER BY n) AS parts FROM walk GROUP BY ALL),
        laid AS (SELECT item_id, count(*) AS c, string_agg(line, chr(10) ORDER BY l) AS whole, max(parts) FILTER (l = 1) AS parts, max(line) FILTER (l = 2) AS two FROM lines GROUP BY item_id),
        moved AS (SELECT *, CASE WHEN c <> 2 THEN 0 ELSE coalesce(list_max(list_filter(range(1, len(parts)), lambda m:
                length(array_to_string(parts[:len(parts) - m], ' ')) >= length(array_to_string(parts[len(parts) - m + 1:], ' ')) + 1 + length(two) AND length(array_to_string(parts[len(parts) - m + 1:], ' ')) + 1 + length(two) <= 60)), 0) END AS m FROM laid)
        SELECT item_id, CASE WHEN c <> 2 THEN whole ELSE array_to_string(parts[:len(parts) - m], ' ') || chr(10) || array_to_string(list_append(parts[len(parts) - m + 1:], two), ' ') END AS lines FROM moved""",
    "memo_misses": """WITH k AS (SELECT doc_id, text, lang, coalesce(text, chr(0)) || chr(0) || coalesce(lang, chr(0)) AS key FROM documents), m AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
        SELECT * FROM (SELECT 'known' AS kind, count(*) AS n FROM k WHERE key IN (SELECT key FROM m) UNION ALL SELECT 'fresh', count(DISTINCT key) FROM k WHERE key NOT IN (SELECT key FROM m)) WHERE n > 0""",
}
