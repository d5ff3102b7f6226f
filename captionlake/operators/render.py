"""Text of whole transcripts: SRT, WebVTT, plain text and markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions.text import chapter_time, srt_time, trim_space, vtt_time


def _joined(rows: DataFrame, order: str, part: Column, name: str, between: str = "") -> DataFrame:
    """For each transcript its parts in order, as one text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), part.alias("part")))), lambda x: x["part"])
    return rows.groupBy("transcript_id").agg(F.array_join(parts, between).alias(name))


def srt(captions: DataFrame) -> DataFrame:
    """transcript_id, srt. A transcript without captions has no row; its text is empty."""
    block = F.concat((F.col("caption_index") + 1).cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n\n"))
    return _joined(captions, "caption_index", block, "srt")


def vtt(captions: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """transcript_id, vtt. With transcripts (transcript_id), those without captions have the header alone."""
    block = F.concat(vtt_time(F.col("start_ms")), F.lit(" --> "), vtt_time(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n\n"))
    body = _joined(captions, "caption_index", block, "body")
    if transcripts is not None:
        body = transcripts.select("transcript_id").distinct().join(body, "transcript_id", "left")
    return body.select("transcript_id", F.concat(F.lit("WEBVTT\n\n"), F.coalesce("body", F.lit(""))).alias("vtt"))


def subtitles(captions: DataFrame, transcripts: DataFrame, formats: Sequence[str]) -> DataFrame:
    """transcript_id, name, content: the files of all formats (srt, vtt) from one grouping; transcripts (transcript_id) without captions have empty ones."""
    cue = F.struct("caption_index", "start_ms", "end_ms", "text")
    listed = captions.groupBy("transcript_id").agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    met = transcripts.select("transcript_id").distinct().join(listed, "transcript_id", "left")
    cues = F.coalesce("cues", F.array().cast(listed.schema["cues"].dataType))
    shown = lambda clock, c: F.concat(clock(c["start_ms"]), F.lit(" --> "), clock(c["end_ms"]), F.lit("\n"), c["text"], F.lit("\n\n"))
    bodies = {
        "srt": F.array_join(F.transform(cues, lambda c: F.concat((c["caption_index"] + 1).cast("string"), F.lit("\n"), shown(srt_time, c))), ""),
        "vtt": F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(cues, lambda c: shown(vtt_time, c)), "")),
    }
    files = F.array(*(F.struct(F.lit(f"subtitles.{f}").alias("name"), bodies[f].alias("content")) for f in formats))
    return met.select("transcript_id", F.explode(files).alias("f")).select("transcript_id", "f.*")


def plain_text(segments: DataFrame) -> DataFrame:
    """transcript_id, text: a trimmed line for each segment; several line ends at the very end are one."""
    joined = _joined(segments, "segment_index", F.concat(trim_space(F.col("text")), F.lit("\n")), "text")
    return joined.withColumn("text", F.regexp_replace("text", "\n+$", "\n"))


def full_text(words: DataFrame) -> DataFrame:
    return _joined(words, "word_index", F.col("text"), "text", " ")


def chunk_text(chunks: DataFrame) -> DataFrame:
    """transcript_id, text: chunks that aren't blank with an empty line between, and a line end."""
    part = F.when(trim_space(F.col("text")) != "", trim_space(F.col("text")))
    return _joined(chunks, "chunk_index", part, "text", "\n\n").withColumn("text", F.concat("text", F.lit("\n")))


def chapters(topics: DataFrame) -> DataFrame:
    """topics: transcript_id, topic_index, title, start_ms, end_ms. Those with a title and some time, the first of each start."""
    valid = topics.filter((trim_space(F.col("title")) != "") & (F.col("start_ms") < F.col("end_ms")))
    first = F.row_number().over(Window.partitionBy("transcript_id", "start_ms").orderBy("topic_index"))
    return valid.withColumn("n", first).filter("n = 1").select("transcript_id", "start_ms", "title")


def _points(points: Column) -> Column:
    lines = F.array_join(F.transform(points, lambda p: F.concat(F.lit("- "), trim_space(p), F.lit("\n"))), "")
    return F.when(F.size(points) > 0, F.concat(F.lit("\n## Key points\n"), lines)).otherwise("")


def _head() -> Column:
    return F.concat(F.lit("# "), "title", F.lit("\n\n"), trim_space(F.col("summary")), F.lit("\n"))


def summary(analyses: DataFrame) -> DataFrame:
    """analyses: transcript_id, title, summary, key_points. transcript_id, markdown."""
    return analyses.select("transcript_id", F.concat(_head(), _points(F.col("key_points"))).alias("markdown"))


def description(analyses: DataFrame) -> DataFrame:
    """analyses: also keywords and topics (title, start_ms, end_ms). The heading of chapters stands wherever there are topics."""
    tags = F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("#"), F.replace(trim_space(k), F.lit(" "), F.lit("")))), " ")
    valid = F.filter("topics", lambda t: (trim_space(t["title"]) != "") & (t["start_ms"] < t["end_ms"]))
    ordered = F.array_sort(F.transform(valid, lambda t, n: F.struct(t["start_ms"].alias("start_ms"), n.alias("n"), t["title"].alias("title"))))
    first = F.filter(ordered, lambda t, n: (n == 0) | (t["start_ms"] != F.get(ordered, n - 1)["start_ms"]))
    lines = F.array_join(F.transform(first, lambda t: F.concat(F.lit("- "), chapter_time(t["start_ms"]), F.lit(" "), t["title"], F.lit("\n"))), "")
    text = F.concat(
        _head(),
        F.when(F.size("keywords") > 0, F.concat(F.lit("\n"), tags, F.lit("\n"))).otherwise(""),
        F.when(F.size("topics") > 0, F.concat(F.lit("\n## Chapters\n\n"), lines)).otherwise(""),
        _points(F.col("key_points")),
    )
    return analyses.select("transcript_id", text.alias("markdown"))
