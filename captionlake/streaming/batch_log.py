"""The state of batch items from a stream of changes, and of sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from captionlake.operators.batches import latest


def latest_states(changes: DataFrame) -> DataFrame:
    """A streaming log as in operators.batches. The last state of each item, in update mode."""
    return latest(changes)


def changed_items(changes: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Runs over what there is; each batch writes the items whose state it changed below path. Begins where the last run ended."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return latest_states(changes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def counted_by_window(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events: ts, event_type. Events by window and type; those later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
