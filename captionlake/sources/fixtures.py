"""The shared test tables in the shape of transcripts.

A conversation is a transcript, a turn a spoken segment, its role the speaker, its words those
between white space. Times follow from word lengths; a comma makes a pause. A turn begins on the
hour of its number, so turns don't overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from captionlake.functions.text import words_of

HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, segment_index, speaker, place (in the segment), text, start_ms, end_ms, confidence (float)."""
    # Dealt once, as turns: all that follows goes by conversation. By a number of partitions, as turns are few bytes for the words they become: Spark would merge them to one.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = table(spark, sf_dir, "conversations").repartition(n, "conv_id").select("conv_id", "turn", "role", words_of(F.col("text")).alias("words"))
    words = turns.select("conv_id", "turn", "role", F.posexplode("words").alias("place", "text"))
    length = F.char_length("text")
    step = length * 60 + 40 + F.when(F.col("text").endswith(","), 900).otherwise(0)
    before = Window.partitionBy("conv_id", "turn").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("turn") * HOUR + F.coalesce(F.sum(step).over(before), F.lit(0))).cast("long")
    timed = words.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + length * 60)
    percent = (F.col("conv_id") * 31 + F.col("turn") * 17 + F.col("place") * 7) % 100
    return timed.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("segment_index"), F.col("role").alias("speaker"), "place", "text", "start_ms", "end_ms", (percent.cast("float") / 100).cast("float").alias("confidence"))


def indexed(words: DataFrame) -> DataFrame:
    """words with word_index, their place in the whole transcript."""
    order = Window.partitionBy("transcript_id").orderBy("segment_index", "place")
    return words.withColumn("word_index", (F.row_number().over(order) - 1).cast("long"))


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, segment_index, start_ms, end_ms, text."""
    words = conversation_words(spark, sf_dir)
    spans = words.groupBy("transcript_id", "segment_index").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("segment_index"), "text")
    return turns.join(spans, ["transcript_id", "segment_index"])
