"""Places where a model of the user's choice joins in: texts to texts, and spans to one analysis.

A provider is a Python function over a list of prompts; it is sent to the executors and called for a
few of them at a time. What it raises is the error of their rows. Prompts, grouping and the reading of
replies are expressions. operators.recovery keeps a log of attempts, and asks again what failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions.text import span_text, trim_space
from captionlake.operators.chunks import span_groups
from captionlake.operators.recovery import Provider, asked

ANALYSIS = "schema_version int, language string, title string, summary string, topics array<struct<start_ms:bigint,end_ms:bigint,title:string,summary:string,key_points:array<string>>>, key_points array<string>, keywords array<string>"
VERSION = 1


def control_prompt(text: Column, styling: str = "semi-formal", structure: str = "prose", context: str = "general") -> Column:
    """A chunk with the line that says how it should read."""
    return F.concat(F.lit(f"[Styling: {styling}] [Structure: {structure}] [Context: {context}]\n"), text)


def normalized(chunks: DataFrame, provider: Provider) -> DataFrame:
    """chunks with the text that the provider gives; error where it gives none."""
    done = asked(chunks, control_prompt(F.col("text")), provider, "_reply", "_why")
    text = trim_space(F.col("_reply"))
    none = F.when(F.coalesce(text, F.lit("")) == "", "no text came back")
    return done.withColumn("error", F.coalesce("_why", none)).withColumn("text", text).drop("_reply", "_why")


# What a reply is made of: strings, braces, what is between, and a quote that nothing closes.
_PARTS = r'(?s)"(?:[^"\\]|\\.)*+"|[{}]|[^{}"]++|"'


def bare_object(reply: Column) -> Column:
    """The first object of a reply, without the fence or prose around it; null where none is whole. Braces in strings don't count."""
    fenced = F.regexp_replace(trim_space(reply), r"^```(?:[A-Za-z0-9]*\n)?", "")
    text = F.when(trim_space(reply).startswith("```"), F.regexp_replace(fenced, "```$", "")).otherwise(reply)
    return _first_object(F.when(F.contains(text, F.lit("{")), F.substring(text, F.instr(text, "{"), F.char_length(text))))


def _first_object(text: Column) -> Column:
    """The object that a text begins with: up to where as many braces are closed as were opened."""
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), F.lit(False).alias("over"), F.lit(False).alias("whole"))

    def step(s: Column, part: Column) -> Column:
        depth = s["depth"] + F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        # An open string is no part of an object.
        next_ = F.struct(depth.alias("depth"), (s["read"] + F.char_length(part)).alias("read"), ((depth == 0) | (part == '"')).alias("over"), ((depth == 0) & (part != '"')).alias("whole"))
        return F.when(s["over"], s).otherwise(next_)

    end = F.aggregate(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), begin, step)
    return F.when(end["whole"], F.substring(text, F.lit(1), end["read"]))


def read_analysis(replies: DataFrame) -> DataFrame:
    """replies: transcript_id, language, reply, and why there is none (error), where that is known. The analysis: its fields, and error. Version and an empty language are put right."""
    why = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    read = replies.select("transcript_id", F.col("language").alias("own"), F.from_json(bare_object(F.col("reply")), ANALYSIS).alias("a"), why.alias("why"))
    missing = F.col("a").isNull() | F.col("a.title").isNull()
    none = F.array().cast("array<string>")
    return read.select(
        "transcript_id", F.lit(VERSION).alias("schema_version"), F.coalesce(F.nullif(F.col("a.language"), F.lit("")), F.col("own")).alias("language"), "a.title",
        F.coalesce("a.summary", F.lit("")).alias("summary"), F.coalesce("a.topics", F.expr("cast(array() as array<struct<start_ms:bigint,end_ms:bigint,title:string,summary:string,key_points:array<string>>>)")).alias("topics"),
        F.coalesce("a.key_points", none).alias("key_points"), F.coalesce("a.keywords", none).alias("keywords"), F.coalesce("why", F.when(missing, "no analysis in the reply")).alias("error"),
    )


def analyzed(spans: DataFrame, provider: Provider, size: int = 4000, transcripts: DataFrame | None = None) -> DataFrame:
    """spans: transcript_id, language, chunk_index, start_ms, end_ms, text. One analysis for each transcript.

    A transcript that fits in one group is asked about once. A longer one is asked about group by
    group, then about all the answers. With transcripts (transcript_id, language), one without spans
    has an empty analysis called "Untitled"; else it has no row. If the answer to one group is missing,
    so is the analysis: its error is that of the first such group.
    """
    line = F.concat(span_text(F.col("start_ms"), F.col("end_ms"), F.col("text")), F.lit("\n"))
    grouped = spans.join(span_groups(spans, size), ["transcript_id", "chunk_index"])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", line.alias("line")))), lambda x: x["line"])
    parts = grouped.groupBy("transcript_id", "language", "group").agg(F.array_join(lines, "").alias("excerpt"))
    parts = parts.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("transcript_id")))
    head = F.when(F.col("n") == 1, F.concat(F.lit("Transcript language: "), "language", F.lit("\n\n"))).otherwise(F.concat(F.lit("Excerpt "), "group", F.lit(":\n")))
    # Parted before they are asked about, so that nothing is asked twice.
    one, part = (asked(parts.filter(which), F.concat(head, "excerpt"), provider) for which in ("n = 1", "n > 1"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("group", "reply"))), lambda x: F.concat(F.lit("--- Partial "), x["group"], F.lit(" ---\n"), x["reply"], F.lit("\n\n")))
    why = F.min(F.when(F.col("error").isNotNull(), F.struct("group", "error")))["error"]
    several = part.groupBy("transcript_id", "language").agg(F.concat(F.array_join(listed, ""), F.lit("One analysis of all of these, please.")).alias("prompt"), why.alias("before"))
    # Where a part has no answer nothing is asked.
    whole = asked(several, F.when(F.col("before").isNull(), F.col("prompt")), provider).select("transcript_id", "language", "reply", F.coalesce("before", "error").alias("error"))
    read = read_analysis(one.select("transcript_id", "language", "reply", "error").union(whole))
    if transcripts is None:
        return read
    empty = F.from_json(F.lit('{"title":"Untitled","summary":"","topics":[],"key_points":[],"keywords":[]}'), ANALYSIS)
    silent = transcripts.join(spans.select("transcript_id").distinct(), "transcript_id", "left_anti").withColumn("a", empty)
    fields = [F.lit(VERSION).alias("schema_version"), "language", *(f"a.{c}" for c in ("title", "summary", "topics", "key_points", "keywords")), F.lit(None).cast("string").alias("error")]
    return read.unionByName(silent.select("transcript_id", *fields))


def transcribed(media: DataFrame, provider: Provider) -> DataFrame:
    """media: transcript_id, path. transcript_id, json of a worker (input of sources.transcripts.worker_transcripts), and error: why there is none."""
    return asked(media.select("transcript_id", "path"), F.col("path"), provider, "json").select("transcript_id", "json", "error")
