"""Budgets of a discovery against plain loops, with one root that holds most rows."""

import random

from pyspark.sql import functions as F

from captionlake.sources import budget as G

FILES, TOKENS = "root string, path string, length long", "root string, rank int, path string, line long, place int, key string"


def _files(rows, max_files, max_bytes):
    kept, n, room = [], {}, {}
    for root, path, size in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if n.get(root, 0) < max_files and size <= room.setdefault(root, max_bytes):
            n[root], room[root] = n.get(root, 0) + 1, room[root] - size
            kept.append((root, path))
    return sorted(kept, key=str)


def test_files_in_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), f"{i:05d}", rng.choice([0, 1, 5, 50, 500, 5000])) for i in range(6000)]
    falling = [("hot", f"{i:05d}", 3000 - i) for i in range(3000)]
    for given, files, room in ((rows, 40, 900), (rows, 3000, 5000), (rows, 5, 10**9), (falling, 7, 6000), (rows, 0, 100)):
        table = spark.createDataFrame(given, FILES).repartition(7)
        got = sorted(((r.root, r.path) for r in G.within_budget(table, files, room).collect()), key=str)
        assert got == _files(given, files, room)


def _tokens(rows, max_terms, max_evidence):
    kept, seen, count, begun = [], {}, {}, {}
    for row in sorted(rows, key=lambda r: (r[0] or "", *r[1:5])):
        root, file, key = row[0], row[:3], row[5]
        terms = seen.setdefault(root, set())
        count[root] = count.get(root, 0) + 1
        before = begun.setdefault(file, len(terms))
        terms.add(key)
        if count[root] <= max_evidence and len(terms) <= max_terms and before < max_terms:
            kept.append(row)
    return sorted(kept, key=str)


def test_terms_in_blocks(spark):
    rng = random.Random(5)
    rows = [(root, rank, f"{path:03d}", line, place, f"k{rng.randrange(1 + path * 3)}") for root, paths in (("hot", 30), ("b", 3), (None, 2)) for rank in (0, 1) for path in range(paths) for line in range(5) for place in range(4)]
    table = spark.createDataFrame(rows, TOKENS).repartition(5)
    for terms, evidence in ((10, 10**6), (40, 10**6), (41, 130), (10**6, 33), (1, 5), (0, 5), (5, 0), (10**6, 10**6)):
        assert sorted((tuple(r) for r in G.within_terms(table, terms, evidence).collect()), key=str) == _tokens(rows, terms, evidence)
    assert G.within_terms(table.limit(0)).count() == 0


def test_one_root_of_a_million_tokens(spark):
    i = F.col("id")
    tokens = spark.range(1_000_000).select(F.lit("r").alias("root"), F.lit(0).alias("rank"), F.format_string("%04d", i % 1000).alias("path"), i.alias("line"), F.lit(0).alias("place"), (i * i % 64_007).cast("string").alias("key"))
    rows = [("r", 0, f"{n % 1000:04d}", n, 0, str(n * n % 64_007)) for n in range(1_000_000)]
    for terms, evidence in ((20_000, 10**6), (10**6, 50_000)):
        kept = G.within_terms(tokens, terms, evidence)
        got = kept.agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines")).first()
        want = _tokens(rows, terms, evidence)
        assert (got.n, got.lines) == (len(want), sum(r[3] for r in want))
    # The tokens stand in windows by block alone; of a root's blocks there are totals.
    windows = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line]
    assert windows and all("_block" in line for line in windows)
