"""Hard negatives against all products, and what the bounds discard."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionlake.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, id string, vec string, dim int, score double, bucket int"


def wanted(rows):
    """By Python's integers."""
    kept = []
    for vec_id, label, vec in rows:
        if None in (vec_id, label, vec) or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    asked = {}
    for r in kept:
        if r[0] % 100 == 0 and (r[0] not in asked or (len(r[2]), r[1], r[2]) < (len(asked[r[0]][2]), *asked[r[0]][1:])):
            asked[r[0]] = r
    out = []
    for a, label, vec in asked.values():
        scored = [(-sum(x * y for x, y in zip(vec, v, strict=True)), i, one) for i, one, v in kept if i != a and len(v) == len(vec)]
        for p, pid in sorted((s, i) for s, i, one in scored if one == label)[:5]:
            near = sorted((s, i) for s, i, one in scored if one != label and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(a, pid, n + 1, i, -p, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, more=("x", "y", 1, 0.5, 2)):
    df = spark.createDataFrame([(*r, *more) for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = df.select(F.col("vec_id").alias("id"), label.alias("label"), H.quantised(F.col("embedding")).alias("vec"))
    return sorted(tuple(r) for r in H.mine(given, given.filter("id % 100 = 0")).collect())


def vectors(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    which = rng.integers(0, 12, n)
    points = (centres[which] + rng.normal(size=(n, dim)) * 0.4) * scale
    return [(int(i), int(which[i] % 10), [float(x) for x in points[i]]) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_same_as_all_products(spark, monkeypatch, dim):
    monkeypatch.setattr(H, "CELLS", 400 * dim)  # several shards
    monkeypatch.setattr(H, "AT_ONCE", 512)
    rows = vectors(1500, dim, dim)
    assert mined(spark, rows) == wanted(rows)


def test_nulls_repeats_ties_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(H, "CELLS", 600)
    same = [0.5, 0.25, 1.0]
    rows = vectors(300, 3, 5) + [(1000 + i, i % 3, same) for i in range(200)]  # one vector in three
    rows += [(100, 4, same), (100, 2, same), (200, 4, same), (200, 4, same), (300, None, same), (400, 1, None), (500, 1, [1.0, None, 2.0]), (600, 1, [float("nan")] * 3), (700, 1, [float("inf"), 0.0, 0.0]), (None, 1, same)]
    rows += [(800, 1, [0.0] * 3), (801, 2, [0.0] * 3), (900, 1, [-1.0] * 3), (2000, 3, [1.0, 1.0]), (2001, 3, [1.0, 2.0]), (2002, 4, [1.0, 1.0]), (2100, 1, []), (2101, 1, []), (2102, 2, [])]
    rows += [(3000, 1, [1e6] * 3), (3001, 1, [1e6, 999_999.0, 1e6]), (3002, 2, [1e6, 999_998.0, 1e6])]
    assert mined(spark, rows) == wanted(rows)


def test_vectors_beyond_a_long_take_no_part(spark):
    rows = [(0, 1, [3e38] * 3), (100, 1, [1.0] * 3), (1, 1, [3e38] * 3), (2, 1, [1.0, 1.0, 2.0]), (3, 2, [1.0, 1.0, 1.5])]
    assert mined(spark, rows) == wanted(rows[1:2] + rows[3:])


def test_empty(spark):
    assert mined(spark, []) == []


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(4000, 64)) * np.geomspace(300, 1, 64)).astype(np.int64)
    labels = rng.integers(0, 5, 4000)
    shard = H.Shard(*H.build(np.arange(4000), labels, data, 5))
    anchors, ids = data[:40], np.arange(40)
    every = np.full((40, 1), H.LEAST), np.full((40, 1), H.MOST)
    who, _, found, score = shard.best(anchors, ids, labels[:40], *every, True, 5)
    for a in range(40):
        all_ = sorted((-int(anchors[a] @ data[j]), j) for j in range(4000) if j != a and labels[j] == labels[a])[:5]
        assert [(-s, i) for s, i in zip(score[who == a].tolist(), found[who == a].tolist(), strict=True)] == [(s, i) for s, i in all_]
    assert shard.verified < 0.2 * sum((labels == labels[a]).sum() for a in range(40))


def test_one_node_for_equal_vectors():
    ids = np.arange(3000)
    shard = H.build(ids, np.zeros(3000, np.int64), np.tile([[3, 4]], (3000, 1)), 5)
    assert len(shard[2]) == 1 and shard[0].tolist() == list(range(10))
