"""Ends as a stream and as a table, from one log, with a restart between."""

import random

from captionlake.streaming import completions as C

LOG = "batch_id long, position long, state string, at_ms long, seq long"
STATES = ("pending", "running", "complete", "failed", "missing", "needs-reprocessing", None)


def test_one_log_two_orders(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.randrange(6), rng.choice(STATES), rng.choice([None, *range(40)]), n) for n in range(400)]
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    for some in (rows[:150], rows[150:151], rows[151:]):
        spark.createDataFrame(some, LOG).repartition(2).write.mode("append").parquet(source)
        C.follow(spark.readStream.schema(LOG).parquet(source), state, out).awaitTermination()
    # Another run finds nothing new.
    C.follow(spark.readStream.schema(LOG).parquet(source), state, out).awaitTermination()
    ends = sorted((r for r in rows if r[2] in C.ENDS), key=lambda r: r[4])
    assert sorted((tuple(r) for r in C.followed(spark, out).collect()), key=lambda r: r[4]) == ends
    last, n = {}, {}
    for r in sorted(ends, key=lambda r: (-1 if r[3] is None else r[3], r[4])):
        last[r[:2]], n[r[:2]] = r, n.get(r[:2], 0) + 1
    want = set()
    for batch in {b for b, _ in last}:
        items = [r for (b, _), r in last.items() if b == batch]
        by_end = sorted(items, key=lambda r: (-1 if r[3] is None else r[3], r[4]))
        want |= {(batch, r[1], r[2], r[3], n[r[:2]], sorted(x[1] for x in items).index(r[1]), by_end.index(r)) for r in items}
    whole = C.orders(C.ended(spark.createDataFrame(rows, LOG)))
    assert {tuple(r) for r in C.orders(C.followed(spark, out)).collect()} == {tuple(r) for r in whole.collect()} == want


def test_empty(spark):
    assert C.orders(C.ended(spark.createDataFrame([], LOG))).count() == 0
