"""Providers that fail: what is asked again, what isn't, and that no failure ends a job."""

import os

import pytest
from pyspark.sql import functions as F

from captionlake.operators import providers as P
from captionlake.operators import recovery as R


def _every_third(folder):
    """Fails every third call that it gets in a task; writes down what it is asked and answers."""

    def provider(prompts, calls=[0]):  # noqa: B006 - counts the calls of one worker
        calls[0] += 1
        good = calls[0] % 3 != 0
        for p in prompts:
            with open(f"{folder}/{p}", "a") as f:
                f.write("a" if good else "x")
        if not good:
            raise TimeoutError("too slow")
        return [p.upper() for p in prompts]

    return provider


def test_two_resumes_answer_all(spark, tmp_path):
    notes, log = tmp_path / "notes", str(tmp_path / "log")
    notes.mkdir()
    prompts = spark.range(90).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("p"), "id").alias("prompt")).repartition(3)
    provider = _every_third(str(notes))
    open_ = []
    for _ in range(6):
        got = R.resume(prompts, provider, log, per_call=2)
        open_.append(got.filter("reply is null").count())
        if not open_[-1]:
            break
    # A third is left of each run, unless the calls of a run were less than three in each task.
    assert 0 < open_[0] < 45 and open_[-1] == 0 and len(open_) <= 4
    assert {(r.key, r.reply) for r in got.collect()} == {(str(n), f"P{n}") for n in range(90)}
    told = {p: (notes / p).read_text() for p in os.listdir(notes)}
    # Each until it was answered, and never after.
    assert len(told) == 90 and all(t.strip("x") == "a" and t.endswith("a") for t in told.values())
    assert {r.key: r.attempts for r in got.collect()} == {p[1:]: len(t) for p, t in told.items()}
    before = R.attempts(spark, log).count()
    R.resume(prompts, lambda prompts: 1 / 0, log)
    assert R.attempts(spark, log).count() == before == sum(map(len, told.values()))


def test_giving_up(spark, tmp_path):
    log = str(tmp_path / "log")
    prompts = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", None), (None, "x"), ("c", "three"), ("d", "mute")], "key string, prompt string")

    def provider(prompts):
        if "three" in prompts:
            raise RuntimeError("no three")
        return [None if p == "mute" else p for p in prompts]

    for _ in range(3):
        got = {r.key: (r.attempts, r.reply, r.error) for r in R.resume(prompts, provider, log, most=2, per_call=1).collect()}
    assert got == {"a": (1, "one", None), "b": (2, None, "nothing to ask"), "c": (2, None, "RuntimeError: no three"), "d": (2, None, "no reply")}
    short = R.asked(prompts, F.col("prompt"), lambda prompts: [], per_call=3).filter("prompt is not null").collect()
    assert all("0 replies" in r.error and r.reply is None for r in short)
    with pytest.raises(ValueError, match="already"):
        R.asked(prompts.withColumn("Reply", F.lit(1)), F.col("prompt"), provider)
    assert R.resume(prompts.limit(0), provider, str(tmp_path / "none")).count() == 0


def test_failures_in_the_providers(spark):
    def fails(prompts):
        raise OSError("gone")

    chunks = spark.createDataFrame([(1, 0, "text")], "transcript_id long, chunk_index long, text string")
    assert [(r.text, r.error) for r in P.normalized(chunks, fails).collect()] == [(None, "OSError: gone")]
    media = spark.createDataFrame([(1, "a.mp3")], "transcript_id long, path string")
    assert [(r.json, r.error) for r in P.transcribed(media, fails).collect()] == [(None, "OSError: gone")]
    spans = spark.createDataFrame([(1, "en", 0, 0, 9, "x"), (2, "en", 0, 0, 9, "y" * 40), (2, "en", 1, 9, 10, "z" * 40)], "transcript_id long, language string, chunk_index long, start_ms long, end_ms long, text string")

    def at_the_end(prompts):
        if any("--- Partial" in p for p in prompts):
            raise OSError("full")
        return ['{"title":"t"}'] * len(prompts)

    assert {(r.transcript_id, r.title, r.error) for r in P.analyzed(spans, at_the_end, size=60).collect()} == {(1, "t", None), (2, None, "OSError: full")}
    # An analysis of some of the parts isn't one of the whole.
    assert {(r.transcript_id, r.error) for r in P.analyzed(spans, fails, size=60).collect()} == {(1, "OSError: gone"), (2, "OSError: gone")}


def test_no_part_is_asked_twice(spark, tmp_path):
    folder = str(tmp_path)

    def provider(prompts):
        for p in prompts:
            with open(f"{folder}/{p.encode().hex()[:120]}", "a") as f:
                f.write("x")
        return ['{"title":"t"}'] * len(prompts)

    spans = spark.createDataFrame([(t, "en", c, 0, 9, f"{t}" * 40) for t in range(1, 6) for c in range(1 + t % 3)], "transcript_id long, language string, chunk_index long, start_ms long, end_ms long, text string")
    assert P.analyzed(spans, provider, size=60).count() == 5
    # Parts, and the wholes of transcripts of several.
    spoken = sum(len((tmp_path / f).read_text()) for f in os.listdir(folder))
    assert spoken == sum(1 + t % 3 for t in range(1, 6)) + sum(t % 3 > 0 for t in range(1, 6))
