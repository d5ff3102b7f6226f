"""The pipeline's stages against plain versions, each on its own input."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from captionlake.llm import packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A corpus of clean texts, junk, exact copies and near copies; sf_dir and the ids of each."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuéö") for _ in range(rng.randint(2, 9)))
    texts, junk, exact, near = [], set(), {}, {}
    for n in range(700):
        words = [word() for _ in range(rng.randint(60, 400))]
        if n % 7 == 0:
            junk.add(len(texts))
            texts.append(" ".join(w.upper() + "!!" for w in words) if n % 2 else " ".join(w + rng.choice(["$$$", "%%%", "***"]) for w in words))
        elif n % 11 == 0:
            exact[len(texts)] = len(texts) + 1
            texts += [" ".join(words), " ".join(words).upper() if n % 2 and all(w.isascii() for w in words) else " ".join(words)]
        elif n % 13 == 0:
            near[len(texts)] = len(texts) + 1
            texts += [" ".join(words), " ".join([*words[:-1], "other"])]
        else:
            texts.append(" ".join(words))
    texts += [None, ""]
    junk |= {len(texts) - 2, len(texts) - 1}
    folder = tmp_path_factory.mktemp("sf")
    n = len(texts)
    pq.write_table(pa.table([pa.array(range(n)), pa.array(texts), pa.array(["en"] * n), pa.array(["src"] * n), pa.array([len(t or "") for t in texts])], names=COLUMNS), f"{folder}/documents.parquet", row_group_size=100)
    labelled = [i for i in range(n) if i % 3]
    pq.write_table(pa.table([pa.array(labelled), pa.array([int(i not in junk) for i in labelled], pa.int32()), pa.array([0] * len(labelled), pa.int32())], names=["doc_id", "quality", "toxic"]), f"{folder}/labels.parquet")
    return str(folder), texts, junk, exact, near


def test_each_stage_decides_on_all_that_came(spark, tables):
    sf_dir, texts, junk, exact, near = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = set(range(len(texts)))
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    low = {n for n, t in enumerate(texts) if model.scores(*quality.as_bytes(pa.array([t or ""])))[0] < corpus_pipeline.THRESHOLD}
    assert len(low & junk) > 0.85 * len(junk) and len(low - junk) < 0.01 * len(texts)
    # Of a copy only the greater id is left, of a near copy the lesser, if both came.
    copies = lambda left: {a for a, b in exact.items() if b in left}
    nears = lambda left: {b for a, b in near.items() if a in left}
    for (_, stage), gone in zip(corpus_pipeline.STAGES[:3], [lambda left: low, copies, nears], strict=True):
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == COLUMNS
        want -= gone(want)
        got = docs.collect()
        assert {r.doc_id for r in got} == want and len(got) == len(want)
        assert all(r.text == texts[r.doc_id] for r in got)
    pieces = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
        assert p.offset + p.length <= packing.WINDOW
    assert set(total) == want and all(total[p.doc_id] == p.doc_tokens for p in pieces)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, pieces))


def test_empty_tables(spark, tables, tmp_path):
    sf_dir = tables[0]
    for name in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{sf_dir}/{name}.parquet").slice(0, 0), f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_in_every_column(spark, tables, tmp_path):
    sf_dir, texts, *_ = tables
    rows = pq.read_table(f"{sf_dir}/documents.parquet").slice(1, 300).to_pylist()
    rows += [dict.fromkeys(COLUMNS)] * 2 + [{**rows[0], "doc_id": None}, {**rows[1], "lang": None, "source": None, "n_chars": None}]
    pq.write_table(pa.Table.from_pylist(rows, pq.read_schema(f"{sf_dir}/documents.parquet")), f"{tmp_path}/documents.parquet")
    pq.write_table(pq.read_table(f"{sf_dir}/labels.parquet"), f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) > 100 and all(r.length > 0 for r in out)
    assert not any(r.doc_id is None for r in out)  # the empty rows score 0, and the null id's text is a copy


def test_clashing_columns(spark, tables, tmp_path):
    sf_dir, *_ = tables
    given = pq.read_table(f"{sf_dir}/documents.parquet").slice(0, 150)
    names = ["_quality", "_id", "_of", "_metadata", "id", "of", "kept", "row", "digest", "locator", "node", "score", "n", "fps", "root"]
    for name in names:
        given = given.append_column(name, pa.array([name] * len(given)))
    pq.write_table(given, f"{tmp_path}/documents.parquet")
    pq.write_table(pq.read_table(f"{sf_dir}/labels.parquet"), f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "test-clash")
        assert n == 3 or docs.columns == COLUMNS + names
    assert docs.count() > 90
