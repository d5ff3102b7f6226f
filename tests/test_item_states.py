"""The state machine of batch items: every move, leases, a whole log against a stream with restarts."""

import random

import pytest
from pyspark.sql import functions as F

from captionlake.operators import batches as B
from captionlake.streaming import item_states

LOG = "batch_id long, position long, state string, at_ms long, seq long, other string"
STATES = ["pending", "running", "running", "complete", "failed", "missing", "needs-reprocessing", "lost", None]


def log(n, seed):
    rng = random.Random(seed)
    return [(rng.randint(0, 3), rng.randint(0, 4), rng.choice(STATES), at, at, "x") for at in sorted(rng.sample(range(1, 20 * n), n))]


def plain(rows, lease, until):
    """By cases, one item after another."""
    out = []
    for item in sorted({r[:2] for r in rows}):
        state, attempt, since = "pending", 0, 0
        for _, _, wanted, at, seq, _ in sorted((r for r in rows if r[:2] == item), key=lambda r: (r[3], r[4])):
            if state == "running" and lease is not None and since + lease <= at:
                state, since = "interrupted", since + lease
                out.append((*item, None, state, state, attempt, since, False))
            if wanted == "pending":
                fine = attempt == 0
            elif wanted == "running":
                fine = state in ("pending", "failed", "missing", "needs-reprocessing", "interrupted")
            elif wanted == "needs-reprocessing":
                fine = state in ("running", "complete")
            else:
                fine = wanted in ("complete", "failed", "missing") and state == "running"
            if fine and wanted != "pending":
                state, since, attempt = wanted, at, attempt + (wanted == "running")
            out.append((*item, seq, wanted, state, attempt, at, not fine))
        if state == "running" and lease is not None and until is not None and since + lease <= until:
            out.append((*item, None, "interrupted", "interrupted", attempt, since + lease, False))
    return sorted(out, key=repr)


def told(rows):
    return sorted(((r.batch_id, r.position, r.seq, r.wanted, r.state, r.attempt, r.at_ms, r.error is not None) for r in rows), key=repr)


@pytest.mark.parametrize("lease, until", [(None, None), (60, None), (60, 5000)])
def test_whole_log(spark, lease, until):
    rows = log(200, 1)
    got = B.history(spark.createDataFrame(rows, LOG), lease, until)
    assert told(got.collect()) == plain(rows, lease, until)


def test_reasons_and_attempts(spark):
    rows = [(1, 0, s, n, n, "") for n, s in enumerate(["complete", "running", "running", "failed", "pending", "running", "complete", "running", "failed", "needs-reprocessing", "needs-reprocessing", "running"])]
    got = sorted(B.history(spark.createDataFrame(rows, LOG)).collect(), key=lambda r: r.seq)
    assert [r.attempt for r in got] == [0, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3]
    assert [r.seq for r in got if r.error] == [0, 2, 4, 7, 8, 10]
    assert got[2].error == B.REFUSED["running"] and got[4].error == "an item that has begun isn't pending again"


def test_one_item_with_many_changes(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("position"), F.when(F.col("id") % 2 == 0, "running").otherwise("failed").alias("state"), F.col("id").alias("at_ms"), F.col("id").alias("seq"))
    last = B.history(rows).agg(F.max("attempt"), F.count("error"), F.count(F.lit(1))).first()
    assert tuple(last) == (n // 2, 0, n)


def test_empty_log(spark):
    assert B.history(spark.createDataFrame([], LOG), 5, 5).collect() == []


def test_stream_with_restarts_tells_what_the_whole_log_does(spark, tmp_path):
    rows, lease = log(240, 2), 60
    end = rows[-1][3] + 1000
    rows.append((99, 0, "running", end, end, "x"))  # moves the watermark past all leases but its own
    before = spark.conf.get(item_states.PROVIDER[0], None)
    spark.conf.set(*item_states.PROVIDER)
    try:
        for part in range(3):  # a run for each third, each begins where the last ended
            step = -(-len(rows) // 3)
            spark.createDataFrame(rows[part * step : (part + 1) * step], LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
            changes = spark.readStream.schema(LOG).parquet(f"{tmp_path}/log")
            query = item_states.item_history(changes, lease).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination(300)
    finally:
        spark.conf.unset(item_states.PROVIDER[0]) if before is None else spark.conf.set(item_states.PROVIDER[0], before)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert told(got) == plain(rows, lease, end)
