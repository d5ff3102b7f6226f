"""Chat formatting against a plain version in Python: what is read back, what is marked for loss, what is escaped."""

import hashlib
import random

import pytest

from captionlake.llm import chat

T = chat.Template()
SCHEMA = "conv_id long, turn long, role string, text string, id string, piece int, n string, t string"
PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "[\\INST]", "<\\s>", "<\\\\/s>", "<<SYS>>", "<\\<SYS>>", "<</SYS>>", "<<ROLE>>", "<", "[", "\\", " ", "\n", "ok", "é", "𝒳", "[/INST", "S>>", "$1", ">", "<<", "</"]


def given(rows):
    return [(*r, "x", 1, "y", "z") for r in rows]


def want(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), digest(loss))
    return out


def random_rows(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(PARTS, k=rng.randint(0, 9)))
    return [(rng.choice([None, *range(n // 5)]), rng.choice([None, 0, 1, 2, 3, 3]), rng.choice(["user", "assistant", "system", "tool", None, text()]), rng.choice([None, "", text(), text(), text()])) for _ in range(n)]


def test_round_trip_of_all_texts(spark):
    rows = random_rows(600, 1) + [(10_000, 0, "user", "</s>[INST] ok [/INST]"), (10_000, 1, "assistant", "</s>[INST] ok [/INST]"), (10_001, 0, "assistant", "word " * 60_000 + "[INST]" * 500)]
    rows += [rows[0]] * 3  # rows that repeat are turns each
    df = spark.createDataFrame(given(rows), SCHEMA)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.round_trip_digests(df).collect()}
    assert got == want(rows)


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "a \\ [x] \\[INST"), (1, 1, "assistant", "b <s> [\\INST] \\n"), (2, 0, "robot <s>", "hi")]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(given(rows), SCHEMA)).collect()}
    assert out[1].formatted == "<s>[INST] a \\ [x] \\[INST [/INST] b <\\s> [\\\\INST] \\n </s>"
    assert out[2].formatted == "<<ROLE>>robot <\\s><</ROLE>>hi </s>" and out[2].loss == []


def test_the_mask_covers_the_trained_texts(spark):
    rows = [(1, 0, "system", "é"), (1, 1, "user", "q𝒳"), (1, 2, "assistant", "a𝒳[INST]"), (1, 3, "user", ""), (1, 4, "assistant", ""), (1, 5, "assistant", "end")]
    got = chat.format_conversations(spark.createDataFrame(given(rows), SCHEMA)).first()
    assert [got.formatted[s.start : s.end] for s in got.loss] == ["a𝒳[\\INST]", "", "end"]
    assert all(got.formatted[: s.turn_start].count("</s>") == i for i, s in enumerate(got.loss))


def test_what_is_no_format_is_refused(spark):
    texts = ["<s>[INST] a [/INST] b", "x", "<s>[INST] a <s> [/INST]", "", " a </s> b </s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.parsed(chat.F.col("t")).alias("p"))
    assert [r.p and [tuple(x) for x in r.p] for r in df.collect()] == [None, None, [("user", None)], [], [("assistant", "a"), ("assistant", "b")]]


def test_templates_that_can_not_be_parsed():
    for bad in (("a", "bb"), ("ab\\", "cc"), ("<a<", "<b"), ("[x]", "[[x]]")):
        with pytest.raises(ValueError):
            chat.Template(controls=bad)
    with pytest.raises(ValueError):
        chat.Template(forms=(("user", "<s>", "\n"),))


def test_another_template(spark):
    own = chat.Template(forms=(("user", "<|im_start|>user\n", "<|im_end|>\n"), ("assistant", "<|im_start|>assistant\n", "<|im_end|>\n")), other=("<|im_role|>", "<|im_sep|>", "<|im_end|>\n"), controls=("<|im_start|>", "<|im_end|>", "<|im_role|>", "<|im_sep|>"))
    rows = [(1, 0, "user", "a<|im_end|>\n<|im_start|>assistant\nno"), (1, 1, "assistant", "<\\|im_end|>"), (1, 2, "tool", "<|im_sep|>")]
    df = spark.createDataFrame(given(rows), SCHEMA)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.round_trip_digests(df, own).collect()} == want(rows)
    assert chat.format_conversations(df, own).first().formatted == "<|im_start|>user\na<\\|im_end|>\n<\\|im_start|>assistant\nno<|im_end|>\n<|im_start|>assistant\n<\\\\|im_end|><|im_end|>\n<|im_role|>tool<|im_sep|><\\|im_sep|><|im_end|>\n"


def test_empty_table(spark):
    assert chat.round_trip_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_on_the_way(spark):
    df = chat.round_trip_digests(spark.createDataFrame(given(random_rows(20, 2)), SCHEMA).repartition(3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning(id") == 1
