"""Text, time and endpoint expressions."""

import pytest
from pyspark.sql import functions as F

from captionlake.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double"}
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v).cast(kinds[type(v)]))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "find", "replace", "want", "n"),
    [
        ("I am John Dough. See.", "john dough", "John Doe", "I am John Doe. See.", 1),
        ("doughnut dough", "dough", "X", "doughnut X", 1),
        ("(dough), dough!", "dough", "X", "(X), X!", 2),
        ("snake_dough_x", "dough", "X", "snake_X_x", 1),
        ("É é", "é", "e", "É e", 1),
        ("édough dough", "dough", "X", "édough X", 1),
        ("remove this now", "remove this", "", " now", 1),
        ("a.b axb", "a.b", "$1\\", "$1\\ axb", 1),
        (r"a \E b", r"\E", "e", "a e b", 1),
    ],
)
def test_phrases(spark, text, find, replace, want, n):
    args = F.col("t"), F.col("f")
    assert one(spark, T.replace_phrase(*args, F.col("r")), t=text, f=find, r=replace) == want
    assert one(spark, T.count_phrase(*args), t=text, f=find) == n


@pytest.mark.parametrize(("seconds", "want"), [(0.3105, 311), (0.0, 0), (-1.0, 0), (float("nan"), 0), (float("inf"), 0), (1.0005, 1001)])
def test_seconds(spark, seconds, want):
    assert one(spark, T.seconds_to_ms(F.col("s")), s=seconds) == want


def test_clocks(spark):
    for ms, srt, vtt in ((0, "00:00:00,000", "00:00.000"), (65_250, "00:01:05,250", "01:05.250"), (3_600_000, "01:00:00,000", "01:00:00.000"), (360_000_001, "100:00:00,001", "100:00:00.001")):
        assert one(spark, T.srt_time(F.col("m")), m=ms) == srt
        assert one(spark, T.vtt_time(F.col("m")), m=ms) == vtt
    assert one(spark, T.chapter_time(F.col("m")), m=3_661_999) == "61:01"
    assert one(spark, T.span_text(F.col("a"), F.col("b"), F.lit("x")), a=1500, b=61_001) == "[0001.500s - 0061.001s] x"
    assert [one(spark, T.human_duration(F.col("m")), m=m) for m in (999, 4500, 92_000)] == ["999ms", "4.5s", "1m 32s"]


def test_white_space_and_keys(spark):
    assert one(spark, T.trim_space(F.col("t")), t=" \t a b  ") == "a b"
    assert one(spark, T.words_of(F.col("t")), t=" a b\n\nc ") == ["a", "b", "c"]
    assert one(spark, T.term_key(F.col("t")), t="Cargo.TOML-É") == "cargotoml"
    assert one(spark, T.similarity(F.col("t"), F.lit("cargotoml")), t="cargo.tomo") == pytest.approx(1 - 1 / 9, abs=1e-6)
    assert one(spark, T.similarity(F.col("t"), F.lit("")), t="...") is None
    assert [one(spark, T.ends_caption(F.col("t")), t=t) for t in ("a.", 'a."', "a!’", "a,", "a. b")] == [True, True, True, False, False]
    assert [one(spark, T.ends_chunk(F.col("t")), t=t) for t in ("a.", 'a."')] == [True, False]


def test_endpoints(spark):
    clean = {"http://u:p@Host:80/v1/?k=1#f": "http://host:80/v1", "https://a": "https://a", "no url": "<invalid-url>"}
    assert {u: one(spark, T.clean_endpoint(F.col("u")), u=u) for u in clean} == clean
    remote = {"http://localhost:11434": False, "http://127.0.0.9/v1": False, "http://[::1]:80": False, "http://[::ffff:127.0.0.1]": False, "https://openrouter.ai": True, "http://127.0.0.1.evil.com": True, "junk": True}
    assert {u: one(spark, T.is_remote(F.col("u")), u=u) for u in remote} == remote
