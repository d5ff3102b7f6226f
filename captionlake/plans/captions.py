"""Caption queries over the conversations, and their DuckDB SQL.

The SQL finds the same captions another way: a recursive walk over the words of each turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.operators import captions as C
from captionlake.operators import render as R
from captionlake.sources import fixtures as X

WORDS = r"""
    tokens AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS list FROM conversations),
    spread AS (SELECT conv_id, turn, role, unnest(list) AS text, generate_subscripts(list, 1) - 1 AS place FROM tokens),
    words AS (
        SELECT conv_id AS transcript_id, turn AS segment_index, role AS speaker, place, text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn, place) - 1 AS word_index,
               turn * 3600000 + coalesce(sum(length(text) * 60 + 40 + CASE WHEN text LIKE '%,' THEN 900 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms,
               (conv_id * 31 + turn * 17 + place * 7) % 100 AS percent
        FROM spread),
    timed AS (SELECT *, start_ms + length(text) * 60 AS end_ms FROM words),
    grouped AS (
        SELECT *, sum(broken) OVER (PARTITION BY transcript_id, segment_index ORDER BY place) AS grp FROM (
            SELECT *, CASE WHEN start_ms - lag(end_ms) OVER s >= 700 OR regexp_matches(lag(text) OVER s, '[.!?]["''”’]*$') THEN 1 ELSE 0 END AS broken
            FROM timed WINDOW s AS (PARTITION BY transcript_id, segment_index ORDER BY place)))"""

#: The walk: in each group the n-th word joins the open caption or begins the next; l counts lines, w is the width of the last.
PACKED = (
    WORDS
    + """,
    ranked AS (SELECT *, row_number() OVER (PARTITION BY transcript_id, segment_index, grp ORDER BY place) AS n FROM grouped),
    walk AS (
        SELECT transcript_id, segment_index, grp, n, place, text, word_index, 1 AS c, 1 AS l, length(text) AS w, start_ms AS s, greatest(start_ms, end_ms) AS e FROM ranked WHERE n = 1
        UNION ALL
        SELECT r.transcript_id, r.segment_index, r.grp, r.n, r.place, r.text, r.word_index,
               CASE WHEN joins THEN c ELSE c + 1 END, CASE WHEN joins AND beside THEN l WHEN joins THEN l + 1 ELSE 1 END,
               CASE WHEN joins AND beside THEN w + 1 + length(r.text) ELSE length(r.text) END,
               CASE WHEN joins THEN s ELSE r.start_ms END, CASE WHEN joins THEN greatest(e, r.end_ms) ELSE greatest(r.start_ms, r.end_ms) END
        FROM (SELECT k.*, r AS r, w + 1 + length(r.text) <= 42 AS beside,
                     greatest(e, r.end_ms) - s <= 6000 AND w <= 42 AND (w + 1 + length(r.text) <= 42 OR length(r.text) <= 42 AND l < 2) AS joins
              FROM walk k JOIN ranked r ON r.transcript_id = k.transcript_id AND r.segment_index = k.segment_index AND r.grp = k.grp AND r.n = k.n + 1)),
    lines AS (SELECT transcript_id, segment_index, grp, c, l, string_agg(text, ' ' ORDER BY n) AS line FROM walk GROUP BY ALL),
    laid AS (SELECT transcript_id, segment_index, grp, c, max(line) FILTER (l = 1) AS one, string_split(max(line) FILTER (l = 1), ' ') AS parts, max(line) FILTER (l = 2) AS two FROM lines GROUP BY ALL),
    moved AS (
        SELECT *, CASE WHEN two IS NULL THEN 0 ELSE coalesce(list_max(list_filter(range(1, len(parts)), lambda m:
            length(array_to_string(parts[:len(parts) - m], ' ')) >= length(array_to_string(parts[len(parts) - m + 1:], ' ')) + 1 + length(two)
            AND length(array_to_string(parts[len(parts) - m + 1:], ' ')) + 1 + length(two) <= 42)), 0) END AS m FROM laid),
    texts AS (
        SELECT transcript_id, segment_index, grp, c, CASE WHEN two IS NULL THEN one ELSE array_to_string(parts[:len(parts) - m], ' ') || chr(10) || array_to_string(list_append(parts[len(parts) - m + 1:], two), ' ') END AS text FROM moved),
    raw AS (
        SELECT transcript_id, segment_index, min(word_index) AS place, min(s) AS start_ms, max(e) AS end_ms, any_value(t.text) AS text, min(word_index) AS word_start, max(word_index) + 1 AS word_end
        FROM walk JOIN texts t USING (transcript_id, segment_index, grp, c) GROUP BY transcript_id, segment_index, grp, c)"""
)

#: Every fifth caption begins half a second early, so that some overlap.
SHIFTED = """,
    early AS (SELECT * REPLACE (CASE WHEN place % 5 = 0 AND start_ms >= 500 THEN start_ms - 500 ELSE start_ms END AS start_ms) FROM raw),
    clamped AS (
        SELECT *, coalesce(after < end_ms, false) AS overlapped, CASE WHEN after < end_ms THEN greatest(after, start_ms) ELSE end_ms END AS repaired_ms
        FROM (SELECT *, lead(start_ms) OVER (PARTITION BY transcript_id ORDER BY start_ms, segment_index, place) AS after FROM early))"""

REPAIRED = (
    PACKED
    + """,
    clamped AS (
        SELECT *, CASE WHEN after < end_ms THEN greatest(after, start_ms) ELSE end_ms END AS repaired_ms
        FROM (SELECT *, lead(start_ms) OVER (PARTITION BY transcript_id ORDER BY start_ms, segment_index, place) AS after FROM raw)),
    shown AS (
        SELECT transcript_id, segment_index, place, start_ms, repaired_ms AS end_ms, text, word_start, word_end,
               row_number() OVER (PARTITION BY transcript_id ORDER BY start_ms, segment_index, place) - 1 AS caption_index
        FROM clamped WHERE repaired_ms > start_ms)"""
)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.indexed(X.conversation_words(spark, sf_dir))


def pause_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = C.pause_groups(C.spoken(words(spark, sf_dir)))
    return grouped.groupBy("transcript_id", "segment_index", "group").agg(F.count(F.lit(1)).alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.captions(words(spark, sf_dir)).drop("place")


def _early(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = C.segmented(words(spark, sf_dir))
    return raw.withColumn("start_ms", F.when((F.col("place") % 5 == 0) & (F.col("start_ms") >= 500), F.col("start_ms") - 500).otherwise(F.col("start_ms")))


def timing_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.timing_repairs(_early(spark, sf_dir))


def caption_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check under a stricter policy than the captions were made by, so that all four kinds occur."""
    return C.findings(C.captions(words(spark, sf_dir)), C.Policy(1, 36, 3000), 16.0)


def srt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.srt(C.captions(words(spark, sf_dir)))


def vtt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vtt(C.captions(words(spark, sf_dir)))


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.plain_text(X.conversation_segments(spark, sf_dir))


def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.full_text(words(spark, sf_dir))


_FINDING = "SELECT transcript_id, caption_index, '{}' AS id, word_start, word_end, ({})::DOUBLE AS measured, {}::DOUBLE AS allowed FROM shown WHERE {} > {}"
_MEASURES = {
    "max-duration": ("end_ms - start_ms", 3000),
    "line-count": ("len(string_split(text, chr(10)))", 1),
    "line-width": ("list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))", 36),
    "reading-speed": ("length(replace(text, chr(10), '')) * 1000.0::DOUBLE / (end_ms - start_ms)", 16),
}
_TIME = "printf('%02d:%02d:%02d{}%03d', {} // 3600000, {} % 3600000 // 60000, {} % 60000 // 1000, {} % 1000)"


def _clock(ms: str, dot: str) -> str:
    long = _TIME.format(dot, *[ms] * 4)
    return long if dot == "," else f"CASE WHEN {ms} >= 3600000 THEN {long} ELSE printf('%02d:%02d.%03d', {ms} // 60000, {ms} % 60000 // 1000, {ms} % 1000) END"


QUERIES = {f.__name__: f for f in (pause_groups, captions, timing_repairs, caption_findings, srt_text, vtt_text, plain_text, full_text)}
SQL = {
    "pause_groups": f"WITH {WORDS} SELECT transcript_id, segment_index, grp::BIGINT AS \"group\", count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM grouped GROUP BY ALL",
    "captions": f"WITH RECURSIVE {REPAIRED} SELECT * EXCLUDE (place) FROM shown",
    "timing_repairs": f"""WITH RECURSIVE {PACKED}{SHIFTED}
        SELECT transcript_id, CASE WHEN repaired_ms <= start_ms THEN 'dropped' ELSE 'shortened' END AS kind, word_start, word_end, start_ms, end_ms AS original_end_ms, repaired_ms AS repaired_end_ms
        FROM clamped WHERE overlapped OR repaired_ms <= start_ms""",
    "caption_findings": f"WITH RECURSIVE {REPAIRED} " + " UNION ALL ".join(_FINDING.format(k, m, a, m, a) for k, (m, a) in _MEASURES.items()),
    "srt_text": f"""WITH RECURSIVE {REPAIRED}
        SELECT transcript_id, string_agg((caption_index + 1) || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY caption_index) AS srt
        FROM shown GROUP BY transcript_id""",
    "vtt_text": f"""WITH RECURSIVE {REPAIRED}
        SELECT transcript_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock('start_ms', '.')} || ' --> ' || {_clock('end_ms', '.')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY caption_index) AS vtt
        FROM shown GROUP BY transcript_id""",
    "plain_text": r"SELECT conv_id AS transcript_id, regexp_replace(string_agg(trim(text, E' \t\n\r') || chr(10), '' ORDER BY turn), '\n+$', chr(10)) AS text FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 0 GROUP BY conv_id",
    "full_text": f"WITH {WORDS} SELECT transcript_id, string_agg(text, ' ' ORDER BY word_index) AS text FROM words GROUP BY transcript_id",
}
