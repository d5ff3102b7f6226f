"""The audit against running every order of the filters document by document."""

import itertools
import random
import re
from collections import defaultdict

from captionlake.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, part string, id int, A int, good string, digest string"
LABELS = "doc_id long, quality int, toxic int, id string, good int"


def wanted(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first.get(t, i)}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = [], defaultdict(int)
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                out.append([part, order, step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in docs], DOCS)
    lab = spark.createDataFrame([(*r, "q", 7) for r in labels], LABELS)
    return sorted(tuple(r) for r in A.interaction_audit(d, lab).collect())


def documents(n, seed):
    rng = random.Random(seed)
    words = [rng.choice(["the", "Of", "AND", "x$", "né", "\x1c", "\x85"]) + str(k) * rng.randint(0, 1) for k in range(300)]
    text = lambda: rng.choice([" ", "\n", "\t \x0b"]).join(rng.choices(words[: rng.choice([5, 300])], k=rng.choice([0, 1, 99, 100, 101, 150, 400])))
    texts = [text() for _ in range(n // 2)]
    return [(rng.randint(0, n), rng.choice([None, "", " \n", rng.choice(texts), rng.choice(texts), rng.choice(texts)]), rng.choice([None, "", "en", "en", "fr", "a\nb"])) for _ in range(n)]


def test_same_as_every_order_by_hand(spark):
    docs = documents(400, 1) + [(None, "same text", "en"), (None, "same text", "en"), (3, "same text", "en"), (3, "same text", "en"), (9, "same text", "de"), (10_000, "wörd " * 60_000, "en")]
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 300)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (5, None, None)]
    assert audited(spark, docs, labels) == wanted(docs, labels)


def test_a_text_of_a_third_of_all_rows(spark):
    docs = [(i, "one and the same text" if i % 3 == 0 else f"text {i}", "en") for i in range(3000)]
    assert audited(spark, docs, []) == wanted(docs, [])


def test_empty_tables(spark):
    assert audited(spark, [], []) == [] and audited(spark, [], [(1, 1, 1)]) == []


def test_blocks_and_parts_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(A, "PARTS", 2)
    docs = [(i, "#" * (i % 2), f"part {i % 50}") for i in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert audited(spark, docs, []) == wanted(docs, [])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
