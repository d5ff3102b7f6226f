"""Encoding and packing against the tokenizers library and a plain model of a packing."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from captionlake.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, ids int"
ODD = [
    None, "", " ", "\n\t", "a", "A B", "don't we'll I'M you're 'tis rock'n'roll '' ' s 's", "x" * 5000, "aaaa" * 300, "été ÉTÉ été",
    "ΣΑΣ όσος İstanbul ß", "数字123と文字", "12345 1a2b", "emoji 🙂🙂 👩‍👩‍👧", "<|endoftext|> mid <|startoftext|>x", "<|endoftext|><|endoftext|>", "a b c　d", "\x1c\x1f\x00", "% $$ **!! ...", "ﬁ ① Ⅳ ½ ²",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(7)
    alphabet = "abcdeABC '.,!?-123éßΣñ数🙂\n\t "
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(n, t, "s", 1) for n, t in enumerate(rows)], DOCS)


def test_encode_digests_equal_the_library(spark, library):
    rows = texts()
    got = {r.doc_id: r for r in bpe.encode_digests(frame(spark, rows), PATH).collect()}
    for n, text in enumerate(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[n]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), text


def test_encode_then_decode(spark, library):
    rows = texts()
    out = bpe.decode(bpe.encode(frame(spark, rows).drop("ids"), PATH), PATH).collect()
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    # A column already called so gives way.
    assert bpe.encode(frame(spark, ["a b"]), PATH).columns == ["doc_id", "text", "source", "ids"]
    twice = bpe.decode(bpe.encode(frame(spark, ["a b"]).withColumnRenamed("source", "DECODED"), PATH), PATH).first()
    assert twice.decoded == library.decode(twice.ids, skip_special_tokens=False) and len(twice) == 4


def same_ids(library, rows):
    got = [(ids, counts) for ids, counts in bpe.load(PATH).encode(rows)]
    ids, counts = (np.concatenate(x) for x in zip(*got, strict=True))
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    wrong = [rows[n] for n, (own, w) in enumerate(zip(np.split(ids, np.cumsum(counts)[:-1]), want, strict=True)) if own.tolist() != w]
    assert not wrong, [ascii(w) for w in wrong[:3]]


def test_every_code_point(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 17):
        part = [chr(c) for c in points[at : at + (1 << 17)]]
        same_ids(library, [" ".join(f"a{c}a !{c}!" for c in part[i : i + 32]) for i in range(0, len(part), 32)])


def test_marks_in_other_orders(library):
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))] + list(bpe._LOWER) + [0x11930, 0x11935]
    same_ids(library, [f"e{chr(c)}\u0345 e\u0345{chr(c)} e{chr(c)}\u0334 \u0627{chr(c)}\u064f e\u0301{chr(c)} \U00011935{chr(c)}" for c in marks])


def test_packing_keeps_every_id_once(spark, library):
    rows = [*texts(), "word " * 9000, "b " * 2048, "c " * 2047, None, "same", "same"]
    pieces = packing.pack(frame(spark, rows).repartition(3), PATH, block=4, with_ids=True).collect()
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids))
    for n, text in enumerate(rows):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        got = sorted(by_doc[n], key=lambda p: p.start)
        assert [i for p in got for i in p.ids] == want
        at = 0
        for p in got:
            assert p.start == at and p.doc_tokens == len(want)
            at += p.length
    for window in by_window.values():
        at = 0
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
    used = sum(p.length for p in pieces)
    assert used > 0.85 * packing.WINDOW * len(by_window)


def test_differencing_is_near_equal_and_raises_the_window_count():
    rng = random.Random(1)
    for top in (300, 1000, 2048):
        for _ in range(40):
            sizes = [rng.randint(1, top) for _ in range(rng.randint(1, 300))]
            windows = packing.pack_block(sizes, 2048)
            assert sorted(n for w in windows for n in w) == list(range(len(sizes))) and max(sum(sizes[n] for n in w) for w in windows) <= 2048
            least = -(-sum(sizes) // 2048)
            assert len(windows) <= (least * 1.01 + 1 if top == 300 else least * 1.06 + 1 if top == 1000 else least * 1.25 + 2)
    assert len(packing.pack_block([1300, 1300, 1300], 2048)) == 3  # two would do by their sum
    assert sorted(packing.pack_block([2048] * 5, 2048)) == [[n] for n in range(5)]
    assert packing.pack_block([], 2048) == []


def test_only_what_exceeds_a_window_is_cut(spark):
    rng = random.Random(3)
    rows = ["ab " * rng.randint(20, 1500) for _ in range(1200)] + ["ab " * 5000]
    pieces = packing.pack(frame(spark, rows).coalesce(1), PATH).collect()
    cut = {p.doc_id for p in pieces if p.length < p.doc_tokens}
    assert cut == {p.doc_id for p in pieces if p.doc_tokens > packing.WINDOW} and len(pieces) == 1200 + -(-5001 // 2048)
    assert sum(p.length for p in pieces) > 0.95 * packing.WINDOW * len({p.sequence_id for p in pieces})


def test_empty_table(spark):
    none = frame(spark, ["x"]).filter(F.lit(False))
    assert bpe.encode_digests(none, PATH).count() == 0
    assert packing.pack(none, PATH).count() == 0
