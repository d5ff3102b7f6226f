"""Exact dedup as a stream against a plain version: nulls, ties, unequal texts of one digest, and a stream that goes on."""

import collections
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from captionlake.llm import exact_dedup as D
from captionlake.llm.queries import SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, digest string, id int, kept int"
ROWS = [
    (1, "Same Text"), (2, "same text"), (7, "SAME TEXT"), (3, "Éa"), (4, "éa"), (5, None), (6, ""), (8, " same text"), (9, "x" * 100_000), (10, "X" * 100_000),
    (None, "same text"), (None, "only null"), (None, "only null"), (11, "twice"), (11, "twice"), (12, "line\nend"), (13, "line\r\nend"),
] + [(100 + n, "hot") for n in range(700)]


def normal(text):
    return (text or "").translate(LOWER)


def check(got):
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[normal(t)].append(i)
    want = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter((r.doc_id, r.text_sha256) for r in got if r.kept)
    assert kept == collections.Counter({(max((i for i in ids if i is not None), default=None), hashlib.sha256(t.encode()).hexdigest()): 1 for t, ids in groups.items()})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 0, 1) for i, t in ROWS], DOCS).repartition(5)


def test_equals_a_plain_version(spark, docs):
    check(D.dedup(docs).collect())
    assert D.dedup(docs.limit(0)).count() == 0
    check(D.dedup(docs.withColumn("_metadata", F.lit("clash"))).collect())


def test_files_with_clashing_columns(spark, docs, tmp_path):
    docs.withColumn("_metadata", F.lit("clash")).withColumn("locator", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert D.located(given)[0] is given  # read where it lies
    check(D.dedup(given).collect())
    check(D.dedup_files(spark, f"{tmp_path}/documents.parquet", max_files=3).collect())
    assert D.dedup(given, carry=True).filter("kept").select("row.*").columns == given.columns


def test_repeated_rows_as_in_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    want = con.execute(SQL["op1_exact_dedup"]).fetchall()
    assert collections.Counter(map(tuple, D.dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == collections.Counter(want)


def test_full_bytes_tell_equal_digests_apart(spark, docs):
    weak = lambda text: F.encode(F.concat(F.lit("d"), F.char_length(text) % 3), "utf-8")
    check(D.dedup(docs, digest=weak).collect())


def test_rows_of_the_input_come_along(spark, docs):
    got = D.dedup(docs, carry=True).filter("kept").select("row.*")
    assert got.columns == docs.columns and got.count() == len({normal(t) for _, t in ROWS})


def test_files_as_a_stream_of_several_batches(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(D.dedup_files(spark, f"{tmp_path}/documents.parquet", max_files=2).collect())


def test_state_goes_on_from_what_was_met(spark, docs, tmp_path):
    digests = docs.select(F.col("doc_id").alias("id"), D.sha256(D.normal(F.col("text"))).alias("digest"), F.concat_ws("#", F.lit("at"), "doc_id", F.xxhash64("text")).alias("locator"))
    a, b = digests.filter("id < 5 or id is null"), digests.filter("id >= 5")
    for part in (a, b):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        state = D.digest_state(spark.readStream.schema(digests.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state")
    found = {bytes(r.digest).hex(): (r.keep_id, r.group_size) for r in state.collect()}
    assert found[hashlib.sha256(b"same text").hexdigest()] == (7, 4) and found[hashlib.sha256(b"hot").hexdigest()] == (799, 700)
    assert sum(n for _, n in found.values()) == len(ROWS)


def test_sql_is_whole():
    assert "op1_exact_dedup" in SQL and "limit" not in SQL["op1_exact_dedup"].lower()
