"""Captions from timed words: segmentation, line layout and repair of overlaps.

Words are given by transcript_id, segment_index, word_index, text, start_ms and end_ms. A pause or
the end of a sentence breaks a caption for certain; between such breaks words are packed greedily
under the policy, by a fold over an array that Spark holds for each group. The fold adds to its
result once for each caption, not for each word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions.text import ends_caption, trim_space

PAUSE_MS = 700  # fixed value: a pause that breaks a caption
SEGMENT = ["transcript_id", "segment_index"]


@dataclass(frozen=True)
class Policy:
    """Fixed values are the defaults: two lines of 42 characters, six seconds."""

    max_lines: int = 2
    max_chars: int = 42
    max_ms: int = 6000

    def __post_init__(self):
        if min(self.max_lines, self.max_chars, self.max_ms) < 1:
            raise ValueError("the limits of a caption policy are at least one")


def spoken(words: DataFrame) -> DataFrame:
    """Trimmed words that aren't blank, with the canonical words that each stands for."""
    source = [F.col("word_index"), F.col("word_index") + 1] if "source_start" not in words.columns else [F.col("source_start"), F.col("source_end")]
    kept = words.select(*SEGMENT, "word_index", trim_space(F.col("text")).alias("text"), "start_ms", "end_ms", source[0].alias("source_start"), source[1].alias("source_end"))
    return kept.filter(F.col("text") != "")


def pause_groups(words: DataFrame) -> DataFrame:
    """spoken words with group: how many certain breaks are before them in their segment."""
    order = Window.partitionBy(*SEGMENT).orderBy("word_index")
    pause = F.greatest(F.col("start_ms") - F.lag("end_ms").over(order), F.lit(0))
    broken = (pause >= PAUSE_MS) | F.lag(ends_caption(F.col("text"))).over(order)
    marked = words.withColumn("broken", F.coalesce(broken, F.lit(False)).cast("int"))
    return marked.withColumn("group", F.sum("broken").over(order)).drop("broken")


_OPEN = "struct<at:int,first:int,lines:array<int>,last:int,start:bigint,end:bigint,done:array<struct<first:int,upto:int,lines:array<int>,start:bigint,end:bigint>>>"


def _pack(words: Column, policy: Policy) -> Column:
    """Captions of one group: the first word of each, the one after its last, the words that begin its lines, and its times."""
    empty = F.from_json(F.lit('{"at":0,"first":-1,"lines":[],"last":0,"start":0,"end":0,"done":[]}'), _OPEN)

    def closed(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), s["at"].alias("upto"), s["lines"].alias("lines"), s["start"].alias("start"), s["end"].alias("end"))))

    def step(s: Column, w: Column) -> Column:
        size = F.char_length(w["text"])
        end = F.greatest(s["end"], w["end_ms"], s["start"])
        beside = s["last"] + 1 + size <= policy.max_chars
        below = (size <= policy.max_chars) & (F.size(s["lines"]) < policy.max_lines)
        joins = (s["first"] >= 0) & (end - s["start"] <= policy.max_ms) & (s["last"] <= policy.max_chars) & (beside | below)
        grown = F.struct(
            (s["at"] + 1).alias("at"), s["first"].alias("first"), F.when(beside, s["lines"]).otherwise(F.concat(s["lines"], F.array(s["at"]))).alias("lines"),
            F.when(beside, s["last"] + 1 + size).otherwise(size).alias("last"), s["start"].alias("start"), end.alias("end"), s["done"].alias("done"),
        )
        begun = F.struct(
            (s["at"] + 1).alias("at"), s["at"].alias("first"), F.array(s["at"]).alias("lines"), size.alias("last"), w["start_ms"].alias("start"),
            F.greatest(w["end_ms"], w["start_ms"]).alias("end"), F.when(s["first"] >= 0, closed(s)).otherwise(s["done"]).alias("done"),
        )
        return F.when(joins, grown).otherwise(begun)

    return F.aggregate(words, empty, step, lambda s: F.when(s["first"] >= 0, closed(s)).otherwise(s["done"]))


def _lines(words: Column, caption: Column) -> Column:
    ends = F.concat(F.slice(caption["lines"], F.lit(2), F.size(caption["lines"])), F.array(caption["upto"]))
    return F.transform(F.arrays_zip(caption["lines"].alias("a"), ends.alias("b")), lambda z: F.array_join(F.transform(F.slice(words, z["a"] + 1, z["b"] - z["a"]), lambda w: w["text"]), " "))


def balanced(lines: Column, max_chars: int) -> Column:
    """The text of a caption's lines; of two, as many words go down as leave the first no shorter than the second."""
    parts = F.split(lines[0], " ")
    n = F.size(parts)

    def longer(m: Column) -> Column:
        down = F.char_length(F.array_join(F.slice(parts, n - m + 1, m), " ")) + 1 + F.char_length(lines[1])
        return (F.char_length(F.array_join(F.slice(parts, 1, n - m), " ")) >= down) & (down <= max_chars)

    moves = F.when(n > 1, F.size(F.filter(F.sequence(F.lit(1), n - 1), longer))).otherwise(0)
    first = F.array_join(F.slice(parts, 1, n - moves), " ")
    second = F.concat_ws(" ", F.when(moves > 0, F.array_join(F.slice(parts, n - moves + 1, moves), " ")), lines[1])
    return F.when(F.size(lines) == 2, F.concat(first, F.lit("\n"), second)).otherwise(F.array_join(lines, "\n"))


def segmented(words: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Captions before repair: transcript_id, segment_index, place (of the first word), start_ms, end_ms, text, word_start, word_end."""
    grouped = pause_groups(spoken(words)).groupBy(*SEGMENT, "group").agg(F.array_sort(F.collect_list(F.struct("word_index", "text", "start_ms", "end_ms", "source_start", "source_end"))).alias("words"))
    # The explode keeps the fold from being worked out anew for each of its uses.
    packed = grouped.select(*SEGMENT, "words", F.explode(_pack(F.col("words"), policy)).alias("c"))
    own = F.slice("words", F.col("c.first") + 1, F.col("c.upto") - F.col("c.first"))
    shaped = packed.select(
        *SEGMENT, F.get("words", F.col("c.first"))["word_index"].alias("place"), F.col("c.start").alias("start_ms"), F.col("c.end").alias("end_ms"), _lines(F.col("words"), F.col("c")).alias("lines"),
        F.array_min(F.transform(own, lambda w: w["source_start"])).alias("word_start"), F.array_max(F.transform(own, lambda w: w["source_end"])).alias("word_end"),
    )
    return shaped.select(*SEGMENT, "place", "start_ms", "end_ms", balanced(F.col("lines"), policy.max_chars).alias("text"), "word_start", "word_end")


def _clamped(captions: DataFrame) -> DataFrame:
    order = Window.partitionBy("transcript_id").orderBy("start_ms", "segment_index", "place")
    after = F.lead("start_ms").over(order)
    return captions.withColumn("overlaps", F.coalesce(after < F.col("end_ms"), F.lit(False))).withColumn("repaired_ms", F.when(F.col("overlaps"), F.greatest(after, F.col("start_ms"))).otherwise(F.col("end_ms")))


def repaired(captions: DataFrame) -> DataFrame:
    """Captions in order of their start, none beyond the start of the next, those without time dropped; numbered by caption_index."""
    kept = _clamped(captions).withColumn("end_ms", F.col("repaired_ms")).drop("overlaps", "repaired_ms").filter("end_ms > start_ms")
    order = Window.partitionBy("transcript_id").orderBy("start_ms", "segment_index", "place")
    return kept.withColumn("caption_index", (F.row_number().over(order) - 1).cast("long"))


def timing_repairs(captions: DataFrame) -> DataFrame:
    """What repair does: kind (shortened, dropped), word_start, word_end, start_ms, original_end_ms, repaired_end_ms."""
    gone = F.col("repaired_ms") <= F.col("start_ms")
    found = _clamped(captions).filter(F.col("overlaps") | gone)
    return found.select("transcript_id", F.when(gone, "dropped").otherwise("shortened").alias("kind"), "word_start", "word_end", "start_ms", F.col("end_ms").alias("original_end_ms"), F.col("repaired_ms").alias("repaired_end_ms"))


def captions(words: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return repaired(segmented(words, policy))


def broken_lines(text: Column, policy: Policy = Policy()) -> Column:
    """A text as lines of the policy's width, as many as it takes; unchanged where it fits in one."""
    from captionlake.functions.text import words_of

    words = F.transform(words_of(text), lambda w: F.struct(w.alias("text")))

    def step(lines: Column, w: Column) -> Column:
        last, size = F.element_at(lines, -1), F.char_length(w["text"])
        beside = (F.size(lines) > 0) & (F.char_length(last) + 1 + size <= policy.max_chars)
        return F.when(beside, F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), w["text"])))).otherwise(F.concat(lines, F.array(w["text"])))

    folded = F.aggregate(words, F.array().cast("array<string>"), lambda lines, w: F.when(F.size(lines) == 0, F.array(w["text"])).otherwise(step(lines, w)))
    return F.when((F.char_length(text) <= policy.max_chars) | (F.size(words) == 0), text).otherwise(balanced(folded, policy.max_chars))


CAPTION_CHECKS = "transcript_id, caption_index, id, word_start, word_end, measured, allowed"


def findings(captions: DataFrame, policy: Policy = Policy(), max_chars_per_second: float = 20.0) -> DataFrame:
    """Where captions break the policy: id (max-duration, line-count, line-width, reading-speed), measured, allowed (doubles)."""
    lines = F.split("text", "\n")
    length = F.col("end_ms") - F.col("start_ms")
    width = F.array_max(F.transform(lines, F.char_length))
    shown = F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    measures = {
        "max-duration": (length, policy.max_ms),
        "line-count": (F.size(lines), policy.max_lines),
        "line-width": (width, policy.max_chars),
        "reading-speed": (F.when(length > 0, shown * 1000.0 / length), max_chars_per_second),
    }
    all_ = F.array(*(F.struct(F.lit(n).alias("id"), m.cast("double").alias("measured"), F.lit(float(a)).alias("allowed")) for n, (m, a) in measures.items()))
    told = captions.select("transcript_id", "caption_index", "word_start", "word_end", F.explode(F.filter(all_, lambda x: x["measured"] > x["allowed"])).alias("x"))
    return told.select("transcript_id", "caption_index", "x.id", "word_start", "word_end", "x.measured", "x.allowed")
