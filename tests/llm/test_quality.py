"""The classifier: its pooling against a plain version, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from captionlake.llm import quality

DOCS = "doc_id long, text string, label int, id long"


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghilmnoprstuéö") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 600))]
        bad = i % 5 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad and i % 2 else " ".join([words[0]] * len(words)) if bad else " ".join(words) + "."
        out.append((i, text, int(not bad)))
    return out


def plain_score(model, text):
    text = text.encode()
    blocks = max(2, -(-(len(text) + 2 * quality.PAD) // quality.HALF))
    data = (bytes(quality.PAD) + text).ljust(blocks * quality.HALF + quality.PAD, b"\0")
    seen = []
    for c in range(blocks - 1):
        at = range(c * quality.HALF, c * quality.HALF + quality.CHUNK)
        top = np.max([sum(model.table[j][data[p + j]] for j in range(quality.WIDTH)) for p in at], axis=0)
        seen.append(np.maximum(np.maximum(top + model.bias, 0) @ model.hidden + model.hidden_bias, 0))
    return 1 / (1 + np.exp(-(np.mean(seen, axis=0) @ model.out + model.out_bias)))


def test_held_out_accuracy_and_whole_texts(spark):
    data = rows(900)
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t, _ in data] + [(5000, None, 1, 1), (5001, "", 1, 1), (None, "x", 1, 1), (0, data[0][1], 1, 1)], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(0, data[0][2]), (1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, keep=["doc_id"]).withColumn("held", quality.held_out(quality.F.col("doc_id"))).collect()
    assert len(got) == len(data) + 4 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].score >= 0.7) == bool(q) for i, _, q in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in data)
    assert len(held) > 150 and sum(held) / len(held) > 0.97
    for i in (0, 5, 7, 10):
        assert by[i].score == pytest.approx(plain_score(model, data[i][1]), abs=1e-4)
    assert by[5000].score == by[5001].score == 0
    # The end of a long text counts: junk after clean text changes its score.
    long = " ".join(t for _, t, q in data[:60] if q)
    both = model.scores(*quality.as_bytes(pa.array([long, long + data[0][1] * 40 + data[5][1] * 40])))
    assert both[0] > both[1]


def test_same_sample_same_model(spark):
    data = rows(200)
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t, _ in data], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int")
    a, b = quality.train(docs, labels, per_class=20), quality.train(docs.repartition(7), labels.repartition(3), per_class=20)
    assert np.array_equal(a.table, b.table) and a.out_bias == b.out_bias


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", 0, 0), (2, None, 0, 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert [r.score for r in quality.score(docs, model).collect()] == [0.5, 0]
    assert quality.score(docs.limit(0), model).count() == 0
    clash = quality.score(docs.withColumnRenamed("id", "Score"), model)
    assert clash.columns == ["doc_id", "text", "label", "score"] and [r.score for r in clash.collect()] == [0.5, 0]


def test_short_junk_is_not_good_and_short_prose_is():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuéö") for _ in range(rng.randint(2, 9)))
    kinds = [
        lambda ws: " ".join(w.upper() + "!!" for w in ws), lambda ws: " ".join(w + rng.choice(["$$$", "%%%", "***"]) for w in ws), lambda ws: " | ".join(ws), lambda ws: " ".join(ws) + ".",
    ]
    texts = [kinds[n % 3 if n % 7 == 0 else 3]([word() for _ in range(rng.randint(5, 700))]) for n in range(1500)]
    model = quality.fit(*quality.as_bytes(pa.array([t.encode() for t in texts])), np.array([int(n % 7 != 0) for n in range(1500)]), share=6 / 7)
    score = lambda rows: model.scores(*quality.as_bytes(pa.array(rows)))
    short = [[kind([word() for _ in range(n)]) for n in (3, 4, 5, 8)] for kind in kinds]
    assert all((score(rows) < 0.7).all() for rows in short[:3])
    assert (score(short[3]) >= 0.7).all()
    assert (score(["FREE!! CASH!!", "$$$ click here $$$", "home | about | login"]) < 0.7).all() and score(["", None]).tolist() == [0, 0]


def test_all_of_a_long_text_is_learned_from():
    """Junk that lies in the middle of long texts only, beyond any window of the beginning."""
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefghil ") for _ in range(n))
    texts = [prose(6000) + ("$%" * 3000 if n % 2 else prose(6000)) + prose(6000) for n in range(200)]
    model = quality.fit(*quality.as_bytes(pa.array([t.encode() for t in texts])), np.array([1 - n % 2 for n in range(200)]), steps=300)
    assert model.scores(*quality.as_bytes(pa.array(["$%" * 50, prose(100)]))).round().tolist() == [0, 1]


def test_long_texts_are_drawn_from_all_over(spark):
    text = b"".join(b"%07d " % i for i in range(40_000))
    short = text[: 1 << 15]
    df = spark.createDataFrame([(bytearray(text),), (bytearray(short),)], "t binary")
    long_, same = (bytes(r[0]) for r in df.select(quality.drawn(quality.F.col("t"), 1 << 15)).collect())
    pieces = [long_[i : i + quality.PIECE] for i in range(0, len(long_), quality.PIECE)]
    places = [text.index(p) for p in pieces]
    assert same == short and len(long_) == 1 << 15 and places[0] == 0 and places[-1] == len(text) - quality.PIECE and places == sorted(places)
    assert max(b - a for a, b in zip(places, places[1:])) < 1.1 * len(text) / len(pieces) + quality.PIECE
