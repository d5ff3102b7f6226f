"""Recorded transcripts: worker output, transcript files and media probes, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.functions.text import parse_seconds, seconds_to_ms, trim_space, words_of


_SPOKEN = "array<struct<id:int,start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double,probability:double>>>>"
WORKER = f"version int, language string, duration double, segments {_SPOKEN}"
TRANSCRIPT = "schema_version int, language string, duration_ms bigint, words array<struct<text:string,start_ms:bigint,end_ms:bigint,confidence:float,speaker:string>>, segments array<struct<start_ms:bigint,end_ms:bigint,text:string,word_start:int,word_end:int>>"
PROBE = "streams array<struct<index:int,codec_type:string,codec_name:string,sample_rate:string,channels:int,width:int,height:int,r_frame_rate:string>>, format struct<format_name:string,duration:string>"


def worker_transcripts(raw: DataFrame) -> DataFrame:
    """raw: transcript_id, json of a worker. Transcripts as rows of the same shape as files.

    Words without times have those of their segment, segments without words the words of their
    text, without confidence. A null language is "unknown". error says why a row is none.
    """
    parsed = raw.select("transcript_id", F.from_json("json", WORKER).alias("w"))

    def words(s):
        start, end = s["start"], s["end"]
        given = F.transform(s["words"], lambda w: F.struct(trim_space(w["word"]).alias("text"), seconds_to_ms(F.coalesce(w["start"], start)).alias("start_ms"), seconds_to_ms(F.coalesce(w["end"], end)).alias("end_ms"), w["probability"].cast("float").alias("confidence"), F.lit(None).cast("string").alias("speaker")))
        spelt = F.transform(words_of(F.coalesce(s["text"], F.lit(""))), lambda w: F.struct(w.alias("text"), seconds_to_ms(start).alias("start_ms"), seconds_to_ms(end).alias("end_ms"), F.lit(None).cast("float").alias("confidence"), F.lit(None).cast("string").alias("speaker")))
        return F.when(F.coalesce(F.size(s["words"]), F.lit(0)) > 0, given).otherwise(spelt)

    segments = F.coalesce("w.segments", F.array().cast(_SPOKEN))
    spread = parsed.select("transcript_id", "w", F.transform(segments, lambda s: F.struct(seconds_to_ms(s["start"]).alias("start_ms"), seconds_to_ms(s["end"]).alias("end_ms"), trim_space(F.coalesce(s["text"], F.lit(""))).alias("text"), words(s).alias("words"))).alias("s"))
    size = F.transform("s", lambda s: F.size(s["words"]))
    upto = lambda i: F.aggregate(F.slice(size, F.lit(1), i), F.lit(0), lambda a, n: a + n)
    placed = F.transform("s", lambda s, i: F.struct(s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), s["text"].alias("text"), upto(i).alias("word_start"), upto(i + 1).alias("word_end")))
    error = F.when(F.col("w.version").isNull(), "no worker output").when(F.col("w.version") != 1, "unsupported version")
    return spread.select(
        "transcript_id", F.lit(1).alias("schema_version"), F.coalesce("w.language", F.lit("unknown")).alias("language"), seconds_to_ms(F.col("w.duration")).alias("duration_ms"),
        F.flatten(F.transform("s", lambda s: s["words"])).alias("words"), placed.alias("segments"), error.alias("error"),
    )


def transcript_files(raw: DataFrame) -> DataFrame:
    """raw: transcript_id, json. The parsed transcript, and error: why it can't be used. No row is dropped."""
    parsed = raw.select("transcript_id", F.from_json("json", TRANSCRIPT).alias("t"), F.get_json_object("json", "$").isNotNull().alias("is_json"))
    rows = parsed.select("transcript_id", F.coalesce("t.schema_version", F.lit(1)).alias("schema_version"), *(F.col(f"t.{c}") for c in ("language", "duration_ms", "words", "segments")), "is_json")
    n = F.coalesce(F.size("words"), F.lit(0))
    outside = F.exists("segments", lambda s: (s["word_start"] > s["word_end"]) | (s["word_end"] > n) | (s["word_start"] < 0))
    early = F.exists("words", lambda w: (w["start_ms"] < 0) | (w["end_ms"] < 0))
    error = (
        F.when(~F.coalesce("is_json", F.lit(False)), "no JSON").when(F.col("schema_version") != 1, "unsupported version")
        .when(F.col("words").isNull() | F.col("segments").isNull(), "words or segments are missing")
        .when(F.coalesce(outside, F.lit(False)), "a segment's words are out of range").when(F.coalesce(early, F.lit(False)), "a time is negative")
    )
    return rows.withColumn("error", error).drop("is_json")


NORMALIZED = "schema_version int, language string, chunks array<struct<start_ms:bigint,end_ms:bigint,text:string>>"


def normalized_files(raw: DataFrame) -> DataFrame:
    """raw: transcript_id, json. The chunks of normalised transcripts: transcript_id, language, chunks, error. No row is dropped."""
    parsed = raw.select("transcript_id", F.from_json("json", NORMALIZED).alias("n"), F.get_json_object("json", "$").isNotNull().alias("is_json"))
    error = F.when(~F.coalesce("is_json", F.lit(False)), "no JSON").when(F.coalesce("n.schema_version", F.lit(1)) != 1, "unsupported version").when(F.col("n.chunks").isNull(), "chunks are missing")
    return parsed.select("transcript_id", "n.language", "n.chunks", error.alias("error"))


def chunks(normalized: DataFrame) -> DataFrame:
    """transcript_id, chunk_index, start_ms, end_ms, text."""
    return normalized.filter(F.col("error").isNull()).select("transcript_id", F.posexplode("chunks").alias("n", "c")).select("transcript_id", F.col("n").cast("long").alias("chunk_index"), "c.*")


def words(transcripts: DataFrame) -> DataFrame:
    """transcript_id, segment_index, word_index, text, start_ms, end_ms, confidence, speaker: the words of each segment.

    A segment names a range of words, so its slice is taken; no join is needed. A word in two
    segments is there twice, a word in none not at all.
    """
    spread = transcripts.select("transcript_id", "words", F.posexplode("segments").alias("segment_index", "s"))
    own = F.slice("words", F.col("s.word_start") + 1, F.greatest(F.col("s.word_end") - F.col("s.word_start"), F.lit(0)))
    placed = spread.select("transcript_id", "segment_index", F.col("s.word_start").alias("first"), F.posexplode(own).alias("place", "w"))
    return placed.select("transcript_id", F.col("segment_index").cast("long").alias("segment_index"), (F.col("first") + F.col("place")).cast("long").alias("word_index"), "w.*")


def segments(transcripts: DataFrame) -> DataFrame:
    spread = transcripts.select("transcript_id", F.posexplode("segments").alias("segment_index", "s"))
    return spread.select("transcript_id", F.col("segment_index").cast("long").alias("segment_index"), "s.start_ms", "s.end_ms", "s.text")


def media(raw: DataFrame) -> DataFrame:
    """raw: path, json of a probe. path, duration_ms (null: missing or wrong), audio, video (arrays of streams)."""
    parsed = raw.select("path", F.from_json("json", PROBE).alias("p"))
    kind = lambda k: F.filter("p.streams", lambda s: s["codec_type"] == k)
    return parsed.select("path", F.col("p.format.format_name").alias("format"), parse_seconds(F.col("p.format.duration")).alias("duration_ms"), kind("audio").alias("audio"), kind("video").alias("video"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """transcript_id (the path) and json: whole files below path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.input_file_name().alias("transcript_id"), F.col("value").alias("json"))
