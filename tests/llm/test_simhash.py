"""Fingerprints and groups against a brute-force version."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from captionlake.llm import graph, simhash


def plain_fingerprint(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def corpus():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 400)}É" for _ in range(rng.randint(1, 300))) for _ in range(60)]
    near = []
    for t in base[:30]:
        words = t.split()
        words[rng.randrange(len(words))] = "Changed"
        near.append("\t".join(words))
    odd = [None, "", " \n ", "One", "one TWO", "one two", "a b c", "A B C", "x y " * 700, "e f g\x0bh", "same same same same"]
    return [*base, *near, *odd, *odd, base[0], base[0]]


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(n + 5, t, "clash", 1) for n, t in enumerate(rows)], "doc_id long, text string, fp string, component_id int").repartition(3)
    for k, radius in ((3, 2), (5, 4), (2, 9)):
        fps = [plain_fingerprint(t, k) for t in rows]
        roots = plain_groups(fps, radius)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, words=k, radius=radius).collect()}
        assert got == {n + 5: (f"{fp:016x}", roots[n] + 5) for n, fp in enumerate(fps)}


def test_a_text_longer_than_a_block(monkeypatch):
    text = " ".join(f"Word{n}" for n in range(900))
    want = [plain_fingerprint(text, k) for k in (1, 3, 5)]
    monkeypatch.setattr(simhash, "BLOCK", 37)
    assert [int(simhash.fingerprint(text.encode(), k)[0]) % 2**64 for k in (1, 3, 5)] == want


@pytest.mark.parametrize(("radius", "tile"), [(2, 16), (4, 8), (7, 32), (0, 8)])
def test_links_of_many_tiles(spark, radius, tile):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds, *(seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)), np.array([0, 1, 2**64 - 1], np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = graph.components(simhash.links(frame, radius=radius, tile=tile)).collect()
    signed = [int(x) for x in fps.view(np.int64)]
    roots = plain_groups([int(x) for x in fps], radius)
    least = {}
    for n, r in enumerate(roots):
        least[r] = min(least.get(r, signed[n]), signed[n])
    want = {signed[n]: least[r] for n, r in enumerate(roots) if signed[n] != least[r]}
    assert {r.node: r.root for r in found} == want


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    links = [(n, n + 1) for n in range(60)] + [(100, n) for n in range(101, 140)] + [(200, 200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for link in links for n in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "z"), (3, "z")], "doc_id long, text string")
    got = simhash.near_duplicates(rows).select("doc_id", "component_id").orderBy(F.col("doc_id")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), (3, 3), (3, 3)]


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts_keep_one_and_others_stay(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"t{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(40):
        base = fresh(rng.randint(150, 900))
        texts = [base]
        for _ in range(rng.randint(0, 4)):  # one of 150 words changed
            places = set(rng.sample(range(len(base)), len(base) // 150))
            texts.append([fresh(1)[0] if i in places else w for i, w in enumerate(base)])
        texts.append(base[: len(base) // 2] + fresh(len(base) // 2))  # too different
        ids = []
        for t in texts[:-1]:
            ids.append(len(rows))
            rows.append(" ".join(t))
        groups += [ids, [len(rows)]]
        rows.append(" ".join(texts[-1]))
    for ids in groups:
        assert all(jaccard(rows[ids[0]], rows[i]) >= 0.87 for i in ids)
    rows += [None, "", "Two words", "two words"]
    groups += [[len(rows) - 4, len(rows) - 3], [len(rows) - 2, len(rows) - 1]]
    docs = spark.createDataFrame([(n, t, "x", 0) for n, t in enumerate(rows)] + [(7, rows[7], "x", 1), (None, "null id text one", "x", 1)], "doc_id long, text string, node string, fp int").repartition(3)
    got = simhash.similar(docs).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id for r in got if r.kept} == {g[0] for g in groups} | {None}
    assert simhash.similar(docs.limit(0)).count() == 0


def test_a_repeated_line_links_no_different_texts(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"t{rng.randint(0, 10**9)}" for _ in range(n))
    rows = []
    for own, times in ((300, 20), (300, 40), (1000, 40)):
        line = fresh(12)
        rows += ["\n".join([fresh(own), *[line] * times]) for _ in range(2)]
        assert jaccard(rows[-2], rows[-1]) < 0.03
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert all(r.kept for r in simhash.similar(docs).collect())


def graded():
    """Texts of three groups whose pairs have similarities of all degrees, some at the limit itself."""
    rng = random.Random(8)
    rows = []
    for size in (40, 200, 300):
        base = [f"g{size}w{n}" for n in range(size)]
        for _ in range(45):
            words = list(base)
            for _ in range(rng.randint(0, size // 18)):
                words[rng.randrange(size)] = f"x{rng.randint(0, 10**9)}"
            rows.append(" ".join(words))
    rows += [" ".join(f"limit{n}" for n in range(k)) for k in (84, 104, 130)]  # 80, 100 and 126 shingles: 0.8, then less
    return rows


@pytest.mark.parametrize("part", [512, 7])
def test_similar_equals_brute_force_near_the_limit(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rows = graded()
    root = list(range(len(rows)))
    close = [(i, j) for j in range(len(rows)) for i in range(j) if jaccard(rows[i], rows[j]) >= 0.8]
    assert 100 < len(close) and any(jaccard(rows[i], rows[j]) < 0.82 for i, j in close)
    for _ in rows:
        for i, j in close:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in simhash.similar(docs).collect() if r.kept}
    assert got == set(root)
    assert 10 < len(got) < len(rows) - 10


def test_recall_of_pairs_at_the_limit(spark):
    """Pairs of their own words each, of all lengths: nearly all at 0.80 to 0.85 are linked, none below 0.8."""
    rng = random.Random(15)
    rows, near, far = [], [], []
    for g in range(500):
        size = rng.choice([9, 20, 60, 150, 400, 700])
        base = [f"g{g}w{n}" for n in range(size)]
        words = list(base) if size > 20 else base[: size - rng.randint(1, 2)]
        for _ in range(0 if size <= 20 else rng.randint(size // 65, max(1, size // 40))):
            words[rng.randrange(size)] = f"x{rng.randint(0, 10**9)}"
        rows += [" ".join(base), " ".join(words)]
        (near if 0.8 <= (j := jaccard(*rows[-2:])) <= 0.85 else far if j < 0.8 else []).append(len(rows) - 2)
    assert len(near) > 100 and len(far) > 50
    kept = {r.doc_id for r in simhash.similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect() if r.kept}
    assert all(i in kept and i + 1 in kept for i in far)
    assert sum(i + 1 not in kept for i in near) >= 0.95 * len(near)


def test_tiles_of_sizes_too_far_apart_are_skipped_and_no_other(spark):
    sizes = spark.range(1, 3000).select(F.col("id").alias("n"), simhash._size_class(F.col("id"), 0.8).alias("c")).collect()
    by = {r.n: r.c for r in sizes}
    assert all(abs(by[n] - by[m]) <= 1 for n in range(1, 2999) for m in range(n, min(2999, int(n / 0.8) + 1), 1 + n // 50) if n >= 0.8 * m)
    assert by[2000] - by[1000] > 1


def test_components_of_a_hub(spark):
    """A star of 100,000 leaves, a chain and repeats; the grouped side is read, not grouped, where it is joined."""
    n = 100_000
    links = spark.range(1, n + 1).select(F.lit(n + 10).alias("a"), F.col("id").alias("b")).union(spark.range(200_000, 200_050).select("id", F.col("id") + 1)).union(spark.createDataFrame([(7, 7), (3, n + 10)], "a long, b long"))
    got = graph.components(links)
    roots = {r.root: r["count"] for r in got.groupBy("root").count().collect()}
    assert roots == {1: n, 200_000: 50}
