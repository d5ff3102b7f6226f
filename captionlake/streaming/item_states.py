"""The states of batch items as a stream: a state machine for each item, with leases that run out.

The moves are those of operators.batches.Item, so a stream that has seen a log, in its order, tells
the same as operators.batches.history does of the whole. Each item keeps its state, attempt and the
time of its last move in a value state, on disk; a timer at the end of its lease makes an item that
still runs then an interrupted one when the watermark passes, whether more changes come or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from captionlake.operators.batches import TOLD, Item

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = ["batch_id", "position", "seq", "wanted", "state", "attempt", "at_ms", "error"]


class ItemStates(StatefulProcessor):
    """Changes of one trigger are taken in order of at_ms, seq and state; those of a later trigger come after them, whatever their time."""

    def __init__(self, lease_ms: int | None):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "state string, attempt long, since_ms long")

    def _now(self) -> Item:
        return Item(*self.item.get()) if self.item.exists() else Item()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["at_ms", "seq", "state"], kind="stable", na_position="first")
        before = item = self._now()
        out = []
        for state, at_ms, seq in zip(given["state"], given["at_ms"].tolist(), given["seq"].tolist(), strict=True):
            item, told = item.after(state, int(at_ms), self.lease_ms)
            out += [(*key, n, *t) for n, t in zip([*[None] * (len(told) - 1), seq], told, strict=True)]
        if item != before:
            self.item.update(tuple(item))
            self._lease(before, item)
        yield self._frame(out)

    def _lease(self, before: Item, item: Item) -> None:
        if self.lease_ms is None:
            return
        if before.state == "running":
            self.handle.deleteTimer(before.since_ms + self.lease_ms)
        if item.state == "running":
            self.handle.registerTimer(item.since_ms + self.lease_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lapsed = self._now().expired(expiredTimerInfo.getExpiryTimeInMs(), self.lease_ms)
        if lapsed:
            self.item.update(tuple(lapsed))
        yield self._frame([(*key, None, "interrupted", *lapsed, None)] if lapsed else [])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=COLUMNS).astype({"seq": "Int64", "attempt": "Int64", "at_ms": "Int64", "wanted": object, "state": object, "error": object})

    def close(self) -> None:
        pass


def item_history(changes: DataFrame, lease_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """changes: a stream of batch_id, position (longs), state, at_ms, seq. The columns of operators.batches.history, in append mode.

    The session has to keep states in RocksDB (PROVIDER).
    """
    timed = changes.select("batch_id", "position", "state", F.coalesce(F.col("at_ms"), F.lit(0)).cast("long").alias("at_ms"), F.col("seq").cast("long").alias("seq"))
    timed = timed.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("batch_id", "position").transformWithStateInPandas(ItemStates(lease_ms), f"batch_id long, position long, seq long, {TOLD}", "append", "eventTime")
