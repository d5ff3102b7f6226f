"""Captions, their repair and checks, against small cases and a sequential model."""

import random

import pytest

from captionlake.operators import captions as C
from captionlake.operators import render as R

WORDS = "transcript_id long, segment_index long, word_index long, text string, start_ms long, end_ms long"


def frame(spark, *segments):
    rows, n = [], 0
    for s, words in enumerate(segments):
        for text, a, b in words:
            rows.append((1, s, n, text, a, b))
            n += 1
    return spark.createDataFrame(rows, WORDS)


def texts(spark, words, *policy):
    return [r.text for r in C.captions(frame(spark, words), C.Policy(*policy)).orderBy("caption_index").collect()]


def evenly(*texts, step=300, gap=10):
    return [(t, n * step, n * step + step - gap) for n, t in enumerate(texts)]


def test_sentences_pauses_width_and_time(spark):
    assert texts(spark, evenly("Hello", "world.", "This", "is")) == ["Hello world.", "This is"]
    assert texts(spark, evenly('"Done."', "then")) == ['"Done."', "then"]
    assert texts(spark, [("one", 0, 300), ("two", 1200, 1500)]) == ["one", "two"]
    assert texts(spark, [("one", 0, 300), ("two", 999, 1500)]) == ["one two"]
    assert texts(spark, evenly("a", "b", "c", "d"), 2, 42, 1000) == ["a b c", "d"]
    assert texts(spark, evenly("ab", "cd"), 1, 5, 6000) == ["ab cd"]
    assert texts(spark, evenly("ab", "cde"), 1, 5, 6000) == ["ab", "cde"]
    assert texts(spark, evenly("🙂🙂", "🙂🙂"), 1, 5, 6000) == ["🙂🙂 🙂🙂"]
    assert texts(spark, evenly("short", "x" * 34, "tail"), 2, 8, 6000) == ["short", "x" * 34, "tail"]
    assert texts(spark, evenly("aaaaa", "bbbbb", "ccccc"), 2, 5, 6000) == ["aaaaa\nbbbbb", "ccccc"]
    assert texts(spark, [(" ", 0, 1), (" x ", 0, 300)]) == ["x"]


def test_sources_and_words_of_two_segments(spark):
    got = C.captions(frame(spark, evenly("cross"), [("boundary.", 300, 600)])).orderBy("caption_index").collect()
    assert [(r.text, r.word_start, r.word_end, r.segment_index) for r in got] == [("cross", 0, 1, 0), ("boundary.", 1, 2, 1)]


def test_repair_and_findings(spark):
    long = "a" * 200 + "."
    words = frame(spark, [(long, 0, 8000)], [("next.", 7000, 9000)], [("instant.", 9500, 9500)])
    raw = C.segmented(words)
    assert {(r.kind, r.word_start, r.original_end_ms, r.repaired_end_ms) for r in C.timing_repairs(raw).collect()} == {("shortened", 0, 8000, 7000), ("dropped", 2, 9500, 9500)}
    kept = C.repaired(raw)
    assert [(r.start_ms, r.end_ms) for r in kept.orderBy("caption_index").collect()] == [(0, 7000), (7000, 9000)]
    found = {(r.id, r.caption_index): r.measured for r in C.findings(kept).collect()}
    assert found == {("max-duration", 0): 7000.0, ("line-width", 0): 201.0, ("reading-speed", 0): 201000 / 7000}
    same = frame(spark, [("one.", 5, 50)], [("two.", 5, 60)])
    assert {(r.kind, r.word_start) for r in C.timing_repairs(C.segmented(same)).collect()} == {("dropped", 0)}
    with pytest.raises(ValueError):
        C.Policy(0)


def model(words, policy):
    """Captions of one segment, word by word."""
    out, open_, before = [], None, None
    for text, a, b in words:
        if open_ and before is not None and a - before >= 700:
            out.append(open_)
            open_ = None
        fits = False
        if open_:
            lines, end = open_["lines"], max(open_["end"], b, open_["start"])
            if end - open_["start"] <= policy.max_ms and len(lines[-1]) <= policy.max_chars:
                if len(lines[-1]) + 1 + len(text) <= policy.max_chars:
                    lines[-1] += " " + text
                    fits = True
                elif len(text) <= policy.max_chars and len(lines) < policy.max_lines:
                    lines.append(text)
                    fits = True
            if fits:
                open_["end"] = end
            else:
                out.append(open_)
        if not fits:
            open_ = {"lines": [text], "start": a, "end": max(a, b)}
        before = b
        if text.rstrip("\"'”’").endswith((".", "!", "?")):
            out.append(open_)
            open_ = None
    out += [open_] if open_ else []
    for c in out:
        if len(c["lines"]) == 2:
            one, two = c["lines"]
            while " " in one:
                head, tail = one.rsplit(" ", 1)
                if len(head) < len(tail) + 1 + len(two) or len(tail) + 1 + len(two) > policy.max_chars:
                    break
                one, two = head, f"{tail} {two}"
            c["lines"] = [one, two]
    return [("\n".join(c["lines"]), c["start"], c["end"]) for c in out]


@pytest.mark.parametrize("policy", [C.Policy(), C.Policy(3, 12, 2500), C.Policy(1, 20, 900)])
def test_segmentation_equals_a_sequential_model(spark, policy):
    rng = random.Random(9)
    segments = []
    for _ in range(60):
        at, words = 0, []
        for _ in range(rng.randint(1, 60)):
            text = "x" * rng.choice([1, 2, 3, 5, 8, 13, 30]) + rng.choice(["", "", "", "", ",", ".", '."'])
            end = at + rng.randint(-50, 400)
            words.append((text, at, max(end, 0)))
            at += rng.choice([100, 300, 300, 900])
        segments.append(words)
    got = {}
    for r in C.segmented(frame(spark, *segments), policy).collect():
        got.setdefault(r.segment_index, []).append((r.place, r.text, r.start_ms, r.end_ms))
    for n, words in enumerate(segments):
        assert [x[1:] for x in sorted(got[n])] == model(words, policy)


def test_long_group_without_a_break(spark):
    words = [(f"w{n}", n * 100, n * 100 + 90) for n in range(6000)]
    got = C.segmented(frame(spark, words)).orderBy("place").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in got] == model(words, C.Policy())


def test_broken_lines(spark):
    from pyspark.sql import functions as F

    cases = {"fits  as it is": "fits  as it is", "aaaa bbbb cccc dddd eeee": "aaaa bbbb cccc\ndddd eeee", "x" * 20 + " y": "x" * 20 + "\ny", " ": " "}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", C.broken_lines(F.col("t"), C.Policy(2, 15, 1)).alias("b")).collect()
    assert {r.t: r.b for r in rows} == cases


def test_renderings(spark):
    made = spark.createDataFrame([(1, 1, 3600, 65250, "second line\ntext"), (1, 0, 1000, 3500, "hello world.")], "transcript_id long, caption_index long, start_ms long, end_ms long, text string")
    assert R.srt(made).first()["srt"] == "1\n00:00:01,000 --> 00:00:03,500\nhello world.\n\n2\n00:00:03,600 --> 00:01:05,250\nsecond line\ntext\n\n"
    all_ = spark.createDataFrame([(1,), (2,)], "transcript_id long")
    assert {r.transcript_id: r.vtt for r in R.vtt(made, all_).collect()} == {1: "WEBVTT\n\n00:01.000 --> 00:03.500\nhello world.\n\n00:03.600 --> 01:05.250\nsecond line\ntext\n\n", 2: "WEBVTT\n\n"}
    parts = spark.createDataFrame([(1, 1, " b "), (1, 0, " a\n"), (1, 2, ""), (1, 3, " ")], "transcript_id long, segment_index long, text string")
    assert R.plain_text(parts).first()["text"] == "a\nb\n"
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, " "), (1, 2, "b"), (2, 0, " ")], "transcript_id long, chunk_index long, text string")
    assert {r.transcript_id: r.text for r in R.chunk_text(chunks).collect()} == {1: "a\n\nb\n", 2: "\n"}


def test_markdown(spark):
    kind = "transcript_id long, title string, summary string, key_points array<string>, keywords array<string>, topics array<struct<title:string,start_ms:long,end_ms:long>>"
    rows = spark.createDataFrame([(1, "T", " s ", [" p "], ["a b", "c"], [("two", 61000, 62000), (" ", 1, 2), ("one", 0, 5), ("late", 61000, 63000), ("none", 9, 9)]), (2, "T", "s", [], [], [(" ", 1, 2)]), (3, "T", "s", [], [], [])], kind)
    assert {r.transcript_id: r.markdown for r in R.summary(rows).collect()} == {1: "# T\n\ns\n\n## Key points\n- p\n", 2: "# T\n\ns\n", 3: "# T\n\ns\n"}
    assert {r.transcript_id: r.markdown for r in R.description(rows).collect()} == {1: "# T\n\ns\n\n#ab #c\n\n## Chapters\n\n- 00:00 one\n- 01:01 two\n\n## Key points\n- p\n", 2: "# T\n\ns\n\n## Chapters\n\n", 3: "# T\n\ns\n"}
