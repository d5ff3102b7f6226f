"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm import ann, bpe, chat, exact_dedup, filter_audit, hard_negatives, lengths, line_dedup, packing, quality, sharding, simhash, warc


def vocabulary() -> str:
    """The public vocabulary file that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op2_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lengths that occur, and a list of context limits."""
    hist = lengths.histogram(table(spark, sf_dir, "documents"), vocabulary())
    limits = spark.createDataFrame([(n,) for n in lengths.LIMITS], "limit long")
    return lengths.answers(lengths.suffix_sums(lengths.with_limits(hist, limits)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), 24)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return dealt.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says what the template's own marks are."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.round_trip_digests(turns.union(more))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = given.select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("vec"))
    return hard_negatives.mine(rows, rows.filter("id % 100 = 0"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op8_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
             l AS (SELECT row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM d),
             k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             c AS (SELECT key, max(doc_id) AS last, true AS hot FROM k WHERE length(key) >= 40 GROUP BY key
                   HAVING count(DISTINCT doc_id) + CASE WHEN bool_or(doc_id IS NULL) THEN 1 ELSE 0 END >= 5),
             m AS (SELECT k.*, coalesce(hot, false) AND last IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY row, doc_id""",
    "op11_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, n, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, role)),
             m AS (SELECT *, '<\\*(?:/?s>|</?SYS>>|</?ROLE>>)|\[\\*/?INST\]' AS mark FROM t),
             s AS (SELECT conv_id, turn, role, text,
                          length(text) + len(regexp_extract_all(text, mark))
                          + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6
                            ELSE 22 + length(role) + len(regexp_extract_all(role, mark)) END AS chars FROM m)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, v.label = a.label AS same,
                          CAST(list_sum(list_transform(list_zip(a.q, v.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
                   FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.q) = len(v.q)),
             p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5""",
    "op13_filter_audit": r"""
        WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
             l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
             d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                          CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
                        + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
                        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
                        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
                   FROM w LEFT JOIN l USING (doc_id)),
             m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
             f(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
             o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM f p, f q, f r, f s, f t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31),
             g AS (SELECT filter_order, x.step, f.b AS own, (SELECT coalesce(sum(e.b), 0) FROM f e WHERE strpos(left(filter_order, x.step - 1), e.c) > 0) AS earlier
                   FROM o, (VALUES (1), (2), (3), (4), (5)) AS x(step), f WHERE f.c = substr(filter_order, x.step, 1)),
             k AS (SELECT part, filter_order, step, own,
                          coalesce(sum(n) FILTER (mask & (CAST(earlier AS INTEGER) | own) = 0), 0) AS kept,
                          coalesce(sum(n) FILTER (mask & CAST(earlier AS INTEGER) = 0 AND mask & own > 0), 0) AS removed,
                          coalesce(sum(n) FILTER (mask & CAST(earlier AS INTEGER) > 0 AND mask & own > 0), 0) AS redundant,
                          coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
                          coalesce(sum(good) FILTER (mask & CAST(earlier AS INTEGER) = 0 AND mask & own > 0), 0) AS good_lost,
                          coalesce(sum(toxic) FILTER (mask & CAST(earlier AS INTEGER) = 0 AND mask & own > 0), 0) AS toxic_lost
                   FROM m, g GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM k""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_ann_graph": op2_ann_graph,
        "op3_packing": op3_packing,
        "op4_length_histogram": op4_length_histogram,
        "op5_simhash": op5_simhash,
        "op6_bpe": op6_bpe,
        "op7_warc": op7_warc,
        "op8_line_dedup": op8_line_dedup,
        "op9_quality": op9_quality,
        "op10_sharding": op10_sharding,
        "op11_chat_format": op11_chat_format,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
