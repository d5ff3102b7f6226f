"""Items of batches in the order in which they end, as they do, and in that of the inputs, from one log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: States that end an attempt.
ENDS = ("complete", "failed", "missing")
ENDED = "batch_id long, position long, state string, at_ms long, seq long"


def ended(changes: DataFrame) -> DataFrame:
    """changes as in operators.batches, a table or a stream. Those that end an attempt; nothing waits for another row."""
    kept = changes.filter(F.col("state").isin(*ENDS))
    return kept.select("batch_id", F.col("position").cast("long").alias("position"), "state", F.col("at_ms").cast("long").alias("at_ms"), F.col("seq").cast("long").alias("seq"))


def follow(changes: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Adds each end to the Parquet files at path, once, as the stream comes to it. Runs over what there is, and begins where the last run ended."""
    return ended(changes).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def followed(spark: SparkSession, path: str) -> DataFrame:
    """What follow has written; files of a run that was killed are left out."""
    return spark.read.schema(ENDED).parquet(path)


def orders(ends: DataFrame) -> DataFrame:
    """Of each item its last end, and its places: batch_id, position, state, at_ms, n_ends, input_place, completion_place (both from 0, in its batch).

    Ends come by at_ms, then seq; one without at_ms comes first. What a batch's places are counted
    over is a row for each of its items, however often these ended.
    """
    last = F.max(F.struct(F.coalesce("at_ms", F.lit(-1)).alias("by"), "seq", "state", "at_ms"))
    items = ends.groupBy("batch_id", "position").agg(last.alias("x"), F.count(F.lit(1)).alias("n_ends"))
    place = lambda *by: (F.row_number().over(Window.partitionBy("batch_id").orderBy(*by)) - 1).cast("long")
    flat = items.select("batch_id", "position", "x.*", "n_ends")
    return flat.select("batch_id", "position", "state", "at_ms", "n_ends", place("position").alias("input_place"), place("by", "seq", "position").alias("completion_place"))
