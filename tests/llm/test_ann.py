"""Nearest neighbours against brute force, and odd vectors."""

import math
import random

import numpy as np

from captionlake.llm import ann

VECTORS = "vec_id long, embedding array<float>, label int, id int"


def brute(rows, query_id, query, k):
    usable = [(i, v) for i, v in rows if i is not None and i != query_id and len(v) == len(query)]
    far = sorted((math.sqrt(sum((float(np.float32(a)) - float(np.float32(b))) ** 2 for a, b in zip(v, query, strict=True))), i) for i, v in usable)
    return [(i, d) for d, i in far[:k]]


def test_recall_order_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    data = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    data[100:400] = data[7]  # many copies of one vector
    rows = [(n, data[n].tolist()) for n in range(1500)]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], VECTORS).repartition(3)
    got = ann.search(frame, frame.filter("vec_id % 50 = 0"), k=10, shard=400).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 50))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        want = brute(rows, q, rows[q][1], 10)
        assert [r.rank for r in found] == list(range(1, 11)) and len({r.vec_id for r in found}) == 10
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        exact = dict(brute(rows, q, rows[q][1], 1499))
        assert all(math.isclose(r.score, exact[r.vec_id], abs_tol=1e-12) for r in found)
        hits += len({r.vec_id for r in found} & {i for i, _ in want})
        if 100 <= q < 400:  # ties go to the smaller ids
            assert [r.vec_id for r in found] == [i for i, _ in want]
    assert hits / (10 * len(by)) >= 0.95


def test_a_tight_group_shuts_no_search_in():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(1600, 32))
    data[:500] = data.mean(axis=0) + 0.05 * rng.normal(size=(500, 32))  # each two about as far from each other, where searches begin
    graph = ann.build(data)
    queries = data[::20]
    found = graph.search(queries, ann.BEAM)[0]
    exact = np.argsort(((queries[:, None] - data) ** 2).sum(axis=2), axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(f[:10]) & set(e)) / 10 for f, e in zip(found, exact, strict=True)]) >= 0.95


def test_a_search_looks_at_a_small_part_of_a_shard():
    rng = np.random.default_rng(8)
    data = rng.normal(size=(12, 16))[rng.integers(0, 12, 12_000)] + 0.4 * rng.normal(size=(12_000, 16))
    graph = ann.build(data, beam=32)
    queries = data[::100]
    graph.looked_at = 0
    found = graph.search(queries, ann.BEAM)[0]
    assert graph.looked_at < 0.1 * len(queries) * len(data)
    exact = np.argsort(((queries[:, None] - data) ** 2).sum(axis=2), axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(f[:10]) & set(e)) / 10 for f, e in zip(found, exact, strict=True)]) >= 0.95


def test_odd_vectors_and_few_candidates(spark):
    rng = random.Random(1)
    good = [(n, [rng.random(), rng.random(), 1.0]) for n in range(6)]
    odd = [(10, None), (11, []), (12, [0.0, 0.0, 0.0]), (13, [1.0, None, 2.0]), (14, [float("nan"), 1.0, 1.0]), (15, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (16, [1.0, 2.0]), (20, [1.0, 2.5])]
    frame = spark.createDataFrame([(i, v, 1, 1) for i, v in good + odd], VECTORS)
    got = ann.search(frame, frame, k=10, shard=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(by) == {0, 1, 2, 3, 4, 5, 16, 20}
    for q, v in good:
        assert [i for _, i in sorted(by[q])] == [i for i, _ in brute(good, q, v, 10)]
    assert by[16] == [(1, 20)] and by[20] == [(1, 16)]
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0, 0), (1, [0.0, 1.0], 0, 0), (2, [1.0, 1.0], 0, 0), (2, [1.0, 1.0], 0, 0)], VECTORS)
    assert sorted((r.query_id, r.vec_id) for r in ann.search(twice, twice.filter("vec_id = 1 and embedding[0] = 1")).collect()) == [(1, 2), (1, 2)]
    # A repeated identifier is asked once, with the least of its vectors.
    assert {(r.query_id, r.vec_id, r.score) for r in ann.search(twice, twice.filter("vec_id = 1")).collect()} == {(1, 2, 1.0)}
    split = spark.createDataFrame([(1, [1.0, 0.0], 0, 0), (1, [0.0, 9.0], 0, 0), (2, [0.0, 8.0], 0, 0)], VECTORS)
    assert ann.search(split, split.filter("vec_id = 1")).first().score == 1


def test_of_equal_distances_the_least_ids():
    data, query = np.array([[0.5, 0], [0, 1], [1, 0], [-1, 0], [0, -1]]), np.zeros(2)
    found, places = np.arange(5), np.arange(6)
    ids, far = ann._nearest(found, places, np.array([9, 8, 7, 2, 1]), data, query, -1, 3)
    assert ids.tolist() == [9, 1, 2] and far.tolist() == [0.5, 1, 1]
    # One node with as many copies as asked for, and another as far.
    ids, _ = ann._nearest(np.arange(2), np.array([0, 2, 3]), np.array([5, 6, 1]), data[1:3], query, -1, 2)
    assert ids.tolist() == [1, 5]
