"""Segments joined to chunks for language models: by characters and sentence ends, and by characters alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionlake.functions.text import ends_chunk, trim_space, words_of

_CHUNK = "struct<start_ms:bigint,end_ms:bigint,text:string>"
_STATE = f"struct<open:{_CHUNK},done:array<{_CHUNK}>>"


def split_words(text: Column, size: int) -> Column:
    """A text cut between words into pieces of at most size characters; a longer word is a piece by itself."""

    def step(pieces: Column, word: Column) -> Column:
        last = F.element_at(pieces, -1)
        fits = (F.size(pieces) > 0) & (F.char_length(F.try_element_at(pieces, F.lit(-1))) + 1 + F.char_length(word) <= size)
        return F.when(fits, F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(pieces, F.array(word)))

    return F.aggregate(words_of(text), F.array().cast("array<string>"), step)


def chunked(segments: DataFrame, size: int = 2000) -> DataFrame:
    """segments: transcript_id, segment_index, start_ms, end_ms, text. transcript_id, chunk_index, start_ms, end_ms, text.

    Chunks of at most size characters end between segments; from half of size on they end with a
    sentence. A longer segment is cut between words, its pieces with its times.
    """
    given = segments.select("transcript_id", "segment_index", "start_ms", "end_ms", trim_space(F.col("text")).alias("text")).filter(F.col("text") != "")
    listed = given.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "start_ms", "end_ms", "text"))).alias("s"))
    half = size // 2
    null = F.lit(None).cast(_CHUNK)

    def chunk(start: Column, end: Column, text: Column) -> Column:
        return F.struct(start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), text.alias("text"))

    def state(open_: Column, done: Column) -> Column:
        return F.struct(open_.alias("open"), done.alias("done")).cast(_STATE)

    def flushed(s: Column) -> Column:
        return F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, x: Column) -> Column:
        length = F.coalesce(F.char_length(s["open"]["text"]), F.lit(0))
        own, sentence = F.char_length(x["text"]), ends_chunk(x["text"])
        long = F.transform(split_words(x["text"], size), lambda p: chunk(x["start_ms"], x["end_ms"], p))
        breaks = s["open"].isNotNull() & ((length + 1 + own > size) | sentence & (length >= half))
        alone = s["open"].isNull() | breaks
        grown = F.when(alone, chunk(x["start_ms"], x["end_ms"], x["text"])).otherwise(chunk(s["open"]["start_ms"], x["end_ms"], F.concat(s["open"]["text"], F.lit(" "), x["text"])))
        done = F.when(breaks, flushed(s)).otherwise(s["done"])
        closes = sentence & (F.when(alone, own).otherwise(length + 1 + own) >= half)
        return F.when(own > size, state(null, F.concat(flushed(s), long))).when(closes, state(null, F.concat(done, F.array(grown)))).otherwise(state(grown, done)).cast(_STATE)

    folded = F.aggregate("s", state(null, F.array().cast(f"array<{_CHUNK}>")), step, flushed)
    return listed.select("transcript_id", F.posexplode(folded).alias("n", "c")).select("transcript_id", F.col("n").cast("long").alias("chunk_index"), "c.*")


def span_groups(spans: DataFrame, size: int = 4000) -> DataFrame:
    """spans: transcript_id, chunk_index, text. Each with group: a group begins where the characters would pass size."""
    listed = spans.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.char_length("text").alias("n")))).alias("s"))

    def step(s: Column, x: Column) -> Column:
        over = (s["chars"] > 0) & (s["chars"] + x["n"] > size)
        group = F.when(over, s["group"] + 1).otherwise(s["group"])
        return F.struct(F.when(over, x["n"]).otherwise(s["chars"] + x["n"]).alias("chars"), group.alias("group"), F.concat(s["out"], F.array(group)).alias("out"))

    begin = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out"))
    groups = listed.select("transcript_id", "s", F.aggregate("s", begin, step, lambda s: s["out"]).alias("g"))
    return groups.select("transcript_id", F.explode(F.arrays_zip("s", "g")).alias("z")).select("transcript_id", F.col("z.s.chunk_index").alias("chunk_index"), F.col("z.g").cast("long").alias("group"))
