"""Queries on correction rules and manifests, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.operators import rules as R
from captionlake.plans.captions import WORDS
from captionlake.sources import files as S
from captionlake.sources import fixtures as X

RULES = [("and", "&"), ("& the", "& a"), ("All rights reserved", "(c)"), ("de la", "del"), ("no such phrase", "never"), ("und", "u.")]
SCOPED = [
    (0, 0, "Open Telemetry", "OpenTelemetry"), (0, 1, "cargo", "Cargo"), (0, 2, "x", "1"), (0, 3, "x", "2"), (1, 0, "CARGO", "cargo.toml"),
    (1, 1, "x", "3"), (1, 2, "new", "n"), (2, 0, "x", "1"), (2, 1, "open telemetry", "OTel"), (2, 2, "open telemetry", "OpenTelemetry"), (2, 3, "É", "e"), (2, 4, "é", "E"),
]
MANIFESTS = [
    ("a/corrections.md", 0, "# names\n\n open telemetry -> OpenTelemetry\r\nremove this ->\nfoo->bar\n  x ->y -> z\n-> nothing\n"),
    ("a/b/corrections.md", 1, "one -> two\n#two -> three\n wide  -> narrow\n"),
]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of each document, to be replaced by its source or language, in three scopes; and some that differ in little."""
    i = F.col("doc_id")
    find = F.regexp_extract("text", "[^ \\t\\r\\n]+ +[^ \\t\\r\\n]+", 0)
    some = X.table(spark, sf_dir, "documents").select((i % 3).alias("scope_rank"), (i + 10).alias("rule_index"), find.alias("find"), F.when(i % 2 == 0, F.col("source")).otherwise(F.col("lang")).alias("replace"))
    return some.filter("find <> ''").union(spark.createDataFrame(SCOPED, some.schema))


def rule_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.winners(_rules(spark, sf_dir))


def rule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conflicts(_rules(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", "text")


def corrected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = R.corrected(_texts(spark, sf_dir), RULES)
    return done.select("doc_id", F.sha2("text", 256).alias("sha256"), *(F.get("counts", F.lit(n)).cast("long").alias(f"n{n}") for n in range(len(RULES))))


def replacement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.replacement_counts(R.corrected(_texts(spark, sf_dir), RULES), RULES)


def unmatched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unmatched(_texts(spark, sf_dir), RULES)


def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifests, where "of" and "de" part what is to be found from what is to be written; and some that show each fault."""
    i = F.col("doc_id")
    docs = X.table(spark, sf_dir, "documents").select(i.cast("string").alias("manifest"), (i % 4).alias("scope_rank"), F.regexp_replace("text", " (of|de) ", " -> ").alias("text"))
    return S.manifest_rules(docs.filter("text IS NOT NULL").union(spark.createDataFrame(MANIFESTS, docs.schema)))


WORD_RULES = [("of the", "OF"), ("the", "THE"), ("de la", "dela "), ("in", "IN ")]


def corrected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word corrections by four rules, two of them of several words."""
    done = R.corrected_words(X.indexed(X.conversation_words(spark, sf_dir)), WORD_RULES)
    return done.withColumn("counts", F.array_join("counts", ","))


def _values(rows: list[tuple]) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def _pattern(find: str) -> str:
    return rf"'(^|[^\pL\pN])(?i:{find})($|[^\pL\pN])'"


def _chain() -> str:
    """Two passes for each rule, as adjacent matches share the character between them."""
    out, before = [], "SELECT doc_id, text AS t FROM documents"
    for n, (find, replace) in enumerate(RULES):
        for k in (0, 1):
            out.append(f"s{n}_{k} AS (SELECT * EXCLUDE (t), regexp_replace(t, {_pattern(find)}, '\\1{replace}\\2', 'g') AS t, len(regexp_extract_all(t, {_pattern(find)})) AS c{n}_{k} FROM ({before}))")
            before = f"SELECT * FROM s{n}_{k}"
    return ", ".join(out)


def walked(rules: list[tuple[str, str]], base: str) -> str:
    """For each rule (SQL for what it finds and what it puts, where {t} is the transcript) a walk over the words of each transcript: a piece grows word by word until it holds the phrase. The last is done<n>."""
    out, before = [], base
    for n, (find, replace) in enumerate(rules):
        kept = "".join(f", c{i}" for i in range(n))
        f, own = find.format(t="w.transcript_id"), find.format(t="transcript_id")
        out.append(f"""
        walk{n} AS (
            SELECT transcript_id, word_index AS a, word_index AS b, trim(text) AS piece, contains(text, {own}) AS hit FROM {before} WHERE word_index = 0
            UNION ALL
            SELECT transcript_id, CASE WHEN hit THEN b + 1 ELSE a END, b + 1, p, contains(p, {own})
            FROM (SELECT k.*, CASE WHEN hit OR piece = '' THEN trim(w.text) WHEN trim(w.text) = '' THEN piece ELSE piece || ' ' || trim(w.text) END AS p
                  FROM walk{n} k JOIN {before} w ON w.transcript_id = k.transcript_id AND w.word_index = k.b + 1)),
        hits{n} AS (SELECT transcript_id, a, b, piece FROM walk{n} WHERE hit),
        done{n} AS (
            SELECT w.transcript_id, segment_index, word_index, start_ms{kept},
                   CASE WHEN h.a IS NULL THEN w.text WHEN h.a = word_index THEN replace(h.piece, {f}, {replace.format(t="w.transcript_id")}) ELSE '' END AS text,
                   CASE WHEN h.a = word_index THEN l.e ELSE w.end_ms END AS end_ms, CASE WHEN h.a = word_index THEN least(w.source_start, l.s) ELSE w.source_start END AS source_start,
                   CASE WHEN h.a = word_index THEN greatest(w.source_end, l.t) ELSE w.source_end END AS source_end,
                   CASE WHEN h.a = word_index THEN (length(h.piece) - length(replace(h.piece, {f}, ''))) // length({f}) ELSE 0 END AS c{n}
            FROM {before} w ASOF LEFT JOIN hits{n} g ON w.transcript_id = g.transcript_id AND w.word_index >= g.a
            LEFT JOIN hits{n} h ON h.transcript_id = g.transcript_id AND h.a = g.a AND w.word_index <= h.b
            LEFT JOIN (SELECT transcript_id, word_index AS b, end_ms AS e, source_start AS s, source_end AS t FROM {before}) l ON l.transcript_id = h.transcript_id AND l.b = h.b)""")
        before = f"done{n}"
    return ",".join(out)


BASE = "base AS (SELECT transcript_id, segment_index, word_index, text, start_ms, end_ms, word_index AS source_start, word_index + 1 AS source_end FROM timed)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SCOPED = f"""v AS (SELECT * FROM (VALUES {_values(SCOPED)}) v(scope_rank, rule_index, find, replace)
        UNION ALL SELECT doc_id % 3, doc_id + 10, regexp_extract(text, '[^ \\t\\r\\n]+ +[^ \\t\\r\\n]+'), CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END FROM documents),
    r AS (SELECT *, {_LOW.format('find')} AS k FROM v WHERE find <> '')"""
_LAST = f"s{len(RULES) - 1}_1"
_TRIM = "regexp_replace({}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"

QUERIES = {f.__name__: f for f in (rule_winners, rule_conflicts, corrected_text, replacement_counts, unmatched_rules, manifest_parse, corrected_words)}
SQL = {
    "rule_winners": f"WITH {_SCOPED} SELECT scope_rank::BIGINT AS scope_rank, rule_index::BIGINT AS rule_index, find, replace FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY scope_rank DESC, rule_index DESC) = 1",
    "rule_conflicts": f"""WITH {_SCOPED}, m AS (
            SELECT *, lag(replace) OVER o AS shadowed, lag(scope_rank) OVER o AS shadowed_scope, arg_max(replace, (scope_rank, rule_index)) OVER p AS winner, max(scope_rank) OVER p AS winner_scope
            FROM r WINDOW o AS (PARTITION BY k ORDER BY scope_rank, rule_index), p AS (PARTITION BY k))
        SELECT find, winner, shadowed, winner_scope::BIGINT AS winner_scope, shadowed_scope::BIGINT AS shadowed_scope, scope_rank::BIGINT AS scope_rank, rule_index::BIGINT AS rule_index
        FROM m WHERE shadowed <> replace AND shadowed <> winner""",
    "corrected_text": f"WITH {_chain()} SELECT doc_id, sha256(t) AS sha256, {', '.join(f'c{n}_0 + c{n}_1 AS n{n}' for n in range(len(RULES)))} FROM {_LAST}",
    "replacement_counts": f"WITH {_chain()} " + " UNION ALL ".join(f"SELECT {n}::BIGINT AS rule_index, '{f}' AS find, sum(c{n}_0 + c{n}_1)::BIGINT AS replacements FROM {_LAST}" for n, (f, _) in enumerate(RULES)),
    "unmatched_rules": " UNION ALL ".join(f"SELECT {n}::BIGINT AS rule_index, '{f}' AS find, '{r}' AS replace WHERE NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, {_pattern(f)}))" for n, (f, r) in enumerate(RULES)),
    "corrected_words": f"""WITH RECURSIVE {WORDS}, {BASE}, {walked([(f"'{f}'", f"'{r}'") for f, r in WORD_RULES], "base")}
        SELECT transcript_id, segment_index, word_index, text, start_ms, end_ms, source_start, source_end,
               CASE WHEN row_number() OVER (PARTITION BY transcript_id ORDER BY word_index) = 1 THEN concat_ws(',', {", ".join(f"(sum(c{n}) OVER (PARTITION BY transcript_id))::BIGINT" for n in range(len(WORD_RULES)))}) END AS counts
        FROM done{len(WORD_RULES) - 1}""",
    "manifest_parse": f"""WITH m AS (SELECT * FROM (VALUES {_values(MANIFESTS)}) v(manifest, scope_rank, text)
                   UNION ALL SELECT doc_id::VARCHAR, doc_id % 4, regexp_replace(text, ' (of|de) ', ' -> ', 'g') FROM documents WHERE text IS NOT NULL),
             l AS (SELECT manifest, scope_rank, unnest(regexp_split_to_array(text, '\\r?\\n')) AS raw, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS line FROM m),
             t AS (SELECT manifest, scope_rank, line, {_TRIM.format('raw')} AS raw FROM l),
             k AS (SELECT *, instr(raw, ' ->') AS hit FROM t WHERE raw <> '' AND raw NOT LIKE '#%')
        SELECT manifest, scope_rank::BIGINT AS scope_rank, row_number() OVER (PARTITION BY manifest ORDER BY line) - 1 AS rule_index,
               CASE WHEN hit > 0 AND raw NOT LIKE '->%' THEN {_TRIM.format('raw[:hit - 1]')} END AS find,
               CASE WHEN hit > 0 AND raw NOT LIKE '->%' THEN {_TRIM.format('raw[hit + 3:]')} END AS replace, line,
               CASE WHEN raw LIKE '->%' THEN 'nothing to find' WHEN hit = 0 THEN 'no separator' END AS error
        FROM k""",
}
