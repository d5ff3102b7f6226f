"""Length sums and shards against plain versions."""

import collections
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from captionlake.llm import lengths, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, key long, docs int"


def corpus():
    rng = random.Random(2)
    rows = [None, "", " ", "a b", "a b", "long " * 9000, "Zürich " * 50]
    return rows + [" ".join(rng.choice(["one", "two", "three", "flügel"]) for _ in range(rng.randint(0, 300))) for _ in range(300)]


def test_every_context_limit(spark):
    rows = corpus()
    docs = spark.createDataFrame([(n, t, 0, 0) for n, t in enumerate(rows)], DOCS).repartition(3)
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    sizes = [len(t.encode(x or "", add_special_tokens=False).ids) for x in rows]
    hist = lengths.histogram(docs, PATH)
    sums = lengths.suffix_sums(hist, block=64)
    got = {r.n_tokens: r for r in lengths.answers(sums).collect()}
    assert set(got) == set(sizes)
    for n, r in got.items():
        assert r.docs == sizes.count(n) and r.docs_at_least == sum(s >= n for s in sizes) and r.tokens_at_least == sum(s for s in sizes if s >= n)
        assert r.tokens_truncated == sum(min(s, n) for s in sizes) and r.share_at_most == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    limits = [0, 1, 63, 64, 65, 512, 2048, 10**6]
    cut = {r.limit: r for r in lengths.truncated(sums, spark.createDataFrame([(x,) for x in [*limits, 64]], "limit long")).collect()}
    assert set(cut) == set(limits)
    for x in limits:
        assert cut[x].tokens_truncated == sum(min(s, x) for s in sizes) and cut[x].docs_truncated == sum(s > x for s in sizes)
    for share in (0.0, 0.25, 0.5, 0.99, 1.0):
        want = next(n for n in sorted(sizes) if sum(s <= n for s in sizes) >= share * len(sizes))
        assert lengths.quantile(sums, share).first()[0] == want


def test_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    sums = lengths.suffix_sums(lengths.histogram(none, PATH))
    assert lengths.answers(sums).count() == 0 and lengths.quantile(sums, 0.5).first()[0] is None
    assert lengths.truncated(sums, spark.createDataFrame([(5,)], "limit long")).first()["tokens_truncated"] == 0
    assert sharding.shard(none, 3).count() == 0


def test_shards_are_even_gapless_and_whole(spark):
    rng = random.Random(4)
    rows = [None, "", "é" * 40] + ["hot text" * 4] * 900 + ["x" * rng.randint(0, 200) + str(n) for n in range(1800)] + ["y" * 3000] * 2
    docs = spark.createDataFrame([(n if n % 700 else None, t, n, 1) for n, t in enumerate(rows)], DOCS).repartition(5)
    out = sharding.shard(docs, 6, tolerance=0.002, parts=4)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "key", "docs", "shard", "slot", "size"]
    assert sorted(r.key for r in got) == list(range(len(rows)))
    slots, total = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r.text == rows[r.key] and r["size"] == len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
    for s in range(6):
        assert sorted(slots[s]) == list(range(len(slots[s])))
    mean = sum(total.values()) / 6
    assert all(abs(v - mean) < 3100 for v in total.values())
    homes = collections.defaultdict(set)  # a small group of equal texts may be cut by a splitter only
    for r in got:
        homes[r.text].add(r.shard)
    assert len(homes["hot text" * 4]) <= 4 and all(max(h) - min(h) < len(h) for h in homes.values())
    clash = docs.withColumnsRenamed({"key": "Slot", "docs": "size"}).withColumns({c: F.lit("x") for c in ("part", "row", "tie", "_metadata", "shard")})
    again = sharding.shard(clash, 6, tolerance=0.002, parts=4)
    assert again.columns == ["doc_id", "text", "part", "row", "tie", "_metadata", "shard", "slot", "size"]
    assert collections.Counter(r.shard for r in again.collect()) and again.filter("part = 'x' and size < 8").count() == 0


def test_repeated_rows_of_one_key(spark):
    docs = spark.createDataFrame([(1, "same", 0, 0)] * 50 + [(2, "other", 0, 0)], DOCS)
    got = sharding.shard(docs, 4, parts=2).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 51 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(slots) == 4 and max(map(len, slots.values())) < 20  # one repeated row is no bound to a shard's size
