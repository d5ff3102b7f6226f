"""Correction rules: composing scopes, applying them to texts and to timed words, and what never fires.

rules: scope_rank (broad first), rule_index, find, replace and anything else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions.text import ascii_lower, count_phrase, phrase_pattern, replace_phrase, trim_space
from captionlake.shared import checkpointed

Rules = Sequence[tuple[str, str]]


def winners(rules: DataFrame) -> DataFrame:
    """Of rules that find the same phrase (ASCII letters in any case) the last of the narrowest scope."""
    last = F.max_by(F.struct(*rules.columns), F.struct("scope_rank", "rule_index"))
    return rules.groupBy(ascii_lower(F.col("find")).alias("_find")).agg(last.alias("_last")).select("_last.*")


def conflicts(rules: DataFrame, *keys: str) -> DataFrame:
    """Rules (of each of keys) whose predecessor for the same phrase says another thing than they do and than the last one does."""
    order = Window.partitionBy(*keys, ascii_lower(F.col("find"))).orderBy("scope_rank", "rule_index")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = rules.select(*keys, "find", "replace", "scope_rank", "rule_index", F.lag("replace").over(order).alias("shadowed"), F.lag("scope_rank").over(order).alias("shadowed_scope"), F.last("replace").over(whole).alias("winner"), F.last("scope_rank").over(whole).alias("winner_scope"))
    return met.filter((F.col("shadowed") != F.col("replace")) & (F.col("shadowed") != F.col("winner"))).select(*keys, "find", "winner", "shadowed", "winner_scope", "shadowed_scope", "scope_rank", "rule_index")


def _array(rules: Rules) -> Column:
    return F.array(*(F.struct(F.lit(f).alias("find"), F.lit(r).alias("replace")) for f, r in rules))


ROUNDS = 4  # of rules of each transcript that one plan holds
CHAINED = 100  # so many rules at most become a step of the plan each


def _folded(text: Column, rules: Column) -> Column:
    """text and counts after an array of rules (find, replace); a rule whose phrase isn't there costs no pattern."""
    begin = F.struct(text.alias("text"), F.array().cast("array<int>").alias("counts"))

    def step(s: Column, r: Column) -> Column:
        there = ascii_lower(s["text"]).contains(ascii_lower(r["find"]))
        changed = F.when(there, replace_phrase(s["text"], r["find"], r["replace"])).otherwise(s["text"])
        count = F.when(there, count_phrase(s["text"], r["find"])).when(s["text"].isNotNull(), F.lit(0))
        return F.struct(changed.alias("text"), F.concat(s["counts"], F.array(count)).alias("counts"))

    return F.aggregate(rules, begin, step)


def corrected(texts: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """texts with the rules applied in turn, each to what the one before left, and counts: how often each did.

    Each of a few rules is a projection with a literal pattern, which is compiled once; more of them
    go through one fold over an array.
    """
    if not rules:
        return texts.withColumn("counts", F.array().cast("array<int>"))
    kept = [F.col(f"`{c}`") for c in texts.columns if c not in (text_col, "counts")]
    row = F.struct(*(kept or [F.lit(1).alias("one")])).alias("row")
    if len(rules) > CHAINED:
        done = texts.select(row, _folded(F.col(text_col), _array(rules)).alias("done"))
        return done.select(*(["row.*"] if kept else []), F.col("done.text").alias(text_col), F.col("done.counts").alias("counts"))
    done = texts.select(row, F.col(text_col).alias("t"))
    for n, (find, replace) in enumerate(rules):
        done = done.select("row", *(f"c{i}" for i in range(n)), count_phrase(F.col("t"), F.lit(find)).alias(f"c{n}"), replace_phrase(F.col("t"), F.lit(find), F.lit(replace)).alias("t"))
    own = [F.col("row").getField(c).alias(c) for c in texts.columns if c not in (text_col, "counts")]
    return done.select(*own, F.col("t").alias(text_col), F.array(*(F.col(f"c{n}") for n in range(len(rules)))).alias("counts"))


def corrected_each(texts: DataFrame, rules: DataFrame, key: str = "transcript_id", text_col: str = "text") -> DataFrame:
    """texts after the rules of their own key (rules: key, scope_rank, rule_index, find, replace), with counts in the rules' order. A table of rules, whatever their number."""
    order = F.struct("scope_rank", "rule_index", F.struct("find", "replace").alias("rule"))
    listed = rules.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["rule"]).alias("_rules"))
    met = texts.join(listed, key, "left").withColumn("_done", _folded(F.col(text_col), F.coalesce("_rules", F.array().cast("array<struct<find:string,replace:string>>"))))
    return met.withColumn(text_col, F.col("_done.text")).withColumn("counts", F.col("_done.counts")).drop("_done", "_rules")


def unmatched_each(texts: DataFrame, rules: DataFrame, key: str = "transcript_id", text_col: str = "text") -> DataFrame:
    """rules of a key whose text, as it is, they don't match; each by itself."""
    met = rules.join(texts.select(key, F.col(text_col).alias("_text")), key)
    there = ascii_lower(F.col("_text")).contains(ascii_lower(F.col("find"))) & F.rlike(F.col("_text"), phrase_pattern(F.col("find")))
    return met.filter(~F.coalesce(there, F.lit(False))).drop("_text")


def replacement_counts(corrected_: DataFrame, rules: Rules) -> DataFrame:
    """rule_index, find, replacements: over all texts."""
    table = F.array(*(F.struct(F.lit(n).cast("long").alias("rule_index"), F.lit(f).alias("find")) for n, (f, _) in enumerate(rules)))
    summed = corrected_.select(F.posexplode("counts").alias("n", "c")).groupBy("n").agg(F.sum("c").cast("long").alias("replacements"))
    return summed.select(F.get(table, F.col("n")).alias("r"), "replacements").select("r.*", "replacements")


def unmatched(texts: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """rule_index, find, replace of the rules that no text matches as it is; each rule by itself, in one pass over the texts."""
    table = _array(rules)
    hits = F.array(*(F.coalesce(F.max(F.rlike(F.col(text_col), phrase_pattern(F.lit(f)))), F.lit(False)) for f, _ in rules))
    told = texts.agg(hits.alias("hits")).select(F.posexplode("hits").alias("n", "hit")).filter(~F.col("hit"))
    return told.select(F.col("n").cast("long").alias("rule_index"), F.get(table, F.col("n"))["find"].alias("find"), F.get(table, F.col("n"))["replace"].alias("replace"))


_RULE = ("find", "replace")


def _first_rule() -> list[Column]:
    return [F.first(c).alias(c) for c in _RULE]


def _overlapping_chosen(slots: DataFrame, more: int) -> DataFrame:
    """slots with ends: whether a match of a phrase of up to more words after its first ends there; of matches that overlap, the leftmost and then the next one beyond it."""
    order = Window.partitionBy("transcript_id", "said").orderBy("word_index")
    near = slots.withColumn("n", F.when(F.col("said"), F.row_number().over(order))).withColumn("parts", F.array("text", *(F.lead("text", k).over(order) for k in range(1, more + 1))))
    at = F.position("find", F.array_join("parts", " "))
    begun = near.withColumn("at", F.when(F.col("said") & (at > 0) & (at <= F.char_length("text") + 1), at))
    upto = F.transform(F.sequence(F.lit(1), F.lit(more + 1)), lambda k: F.char_length(F.array_join(F.slice("parts", F.lit(1), k), " ")))
    last = F.col("n") + F.size(F.filter(upto, lambda length: length + 1 < F.col("at") + F.char_length("find") - 1))
    found = begun.withColumn("last", F.when(F.col("at").isNotNull(), last)).drop("parts", "at")
    # Matches that overlap one another are put in one row, with the words they cover; other words stay rows of their own.
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    met = found.withColumn("fresh", (F.col("last").isNotNull() & F.coalesce(F.col("n") > before, F.lit(True))).cast("long"))
    covered = F.col("said") & (F.col("n") <= F.max("last").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keyed = met.withColumn("key", F.when(covered, -F.sum("fresh").over(order)).otherwise(F.col("word_index") + 1)).drop("fresh")
    row = F.struct(*(c for c in keyed.columns if c not in ("transcript_id", "key", "word_index", *_RULE)))
    grouped = keyed.groupBy("transcript_id", "key").agg(*_first_rule(), F.array_sort(F.collect_list(F.struct("word_index", row.alias("r")))).alias("rows"))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("ends"))

    def step(s: Column, x: Column) -> Column:
        taken = x["r"]["last"].isNotNull() & (x["r"]["n"] > s["end"])
        return F.when(taken, F.struct(x["r"]["last"].cast("int").alias("end"), F.concat(s["ends"], F.array(x["r"]["last"].cast("int"))).alias("ends"))).otherwise(s)

    chosen = grouped.select("transcript_id", *_RULE, "rows", F.aggregate("rows", none, step)["ends"].alias("chosen"))
    spread = chosen.select("transcript_id", *_RULE, "chosen", F.explode("rows").alias("x")).select("transcript_id", *_RULE, "x.word_index", "x.r.*", "chosen")
    return spread.withColumn("ends", F.coalesce(F.array_contains("chosen", F.col("n").cast("int")), F.lit(False))).drop("chosen", "n", "last")


def _slots(words: DataFrame) -> DataFrame:
    return words.select("transcript_id", "word_index", "segment_index", F.coalesce("text", F.lit("")).alias("raw"), "start_ms", "end_ms", F.col("word_index").alias("source_start"), (F.col("word_index") + 1).alias("source_end"))


def _one_rule(slots: DataFrame, k: int, more: int) -> DataFrame:
    """slots (with find and replace, null where a transcript has no such rule) after the rule, and how often it did something as c<k>. more: the blanks in the phrase, at most."""
    kept = [c for c in slots.columns if c not in ("transcript_id", "word_index", "raw", "end_ms", "source_start", "source_end", *_RULE)]
    by_place = Window.partitionBy("transcript_id").orderBy("word_index")
    slots = slots.withColumn("text", trim_space(F.col("raw"))).withColumn("said", F.col("text") != "")
    slots = _overlapping_chosen(slots, more) if more else slots.withColumn("ends", F.coalesce(F.col("text").contains(F.col("find")), F.lit(False)))
    ended = F.col("ends").cast("long")
    counted = slots.withColumn("earlier", F.coalesce(F.sum(ended).over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum(ended).over(Window.partitionBy("transcript_id")))
    keyed = counted.withColumn("key", F.when(F.col("earlier") < F.col("all"), -1 - F.col("earlier")).otherwise(F.col("word_index")))
    one = F.array_sort(F.collect_list(F.struct("word_index", "raw", "text", "end_ms", "source_start", "source_end", *kept)))
    met = keyed.groupBy("transcript_id", "key").agg(*_first_rule(), F.max("ends").alias("matched"), one.alias("x"))
    met = met.select("transcript_id", *_RULE, "matched", "x", F.array_join(F.filter(F.transform("x", lambda w: w["text"]), lambda t: t != ""), " ").alias("joined"), F.element_at("x", -1).alias("last"))
    count = ((F.char_length("joined") - F.char_length(F.replace("joined", F.col("find"), F.lit("")))) / F.char_length("find")).cast("int")
    spread = met.select("transcript_id", "matched", "last", F.replace("joined", F.col("find"), F.col("replace")).alias("replaced"), F.when(F.col("matched"), count).alias("n"), F.posexplode("x").alias("at", "w"))
    taken = F.col("matched") & (F.col("at") == 0)
    then = lambda new, old: F.when(taken, new).otherwise(old)
    return spread.select(
        "transcript_id", "w.word_index", *(f"w.{c}" for c in kept), F.when(taken, F.col("replaced")).when(F.col("matched"), "").otherwise(F.col("w.raw")).alias("raw"), then(F.col("last.end_ms"), F.col("w.end_ms")).alias("end_ms"),
        then(F.least("w.source_start", "last.source_start"), F.col("w.source_start")).alias("source_start"), then(F.greatest("w.source_end", "last.source_end"), F.col("w.source_end")).alias("source_end"), then(F.col("n"), F.lit(0)).alias(f"c{k}"),
    )


def _told(slots: DataFrame, n_rules: int) -> DataFrame:
    whole = Window.partitionBy("transcript_id")
    totals = F.array(*(F.sum(f"c{k}").over(whole).cast("int") for k in range(n_rules))).cast("array<int>")
    first = F.row_number().over(whole.orderBy("word_index")) == 1
    return slots.select("transcript_id", "segment_index", "word_index", F.col("raw").alias("text"), "start_ms", "end_ms", "source_start", "source_end", F.when(first, totals).alias("counts"))


def corrected_words(words: DataFrame, rules: Rules) -> DataFrame:
    """words (with transcript_id, segment_index, word_index, text, start_ms, end_ms) after the rules, in each transcript on its own.

    A rule's phrase is looked for as it is, case and parts of words too, in the words joined by
    blanks. All words since the last match become one with those it stands in: the first takes the
    text and the last one's end, the others are blank. A match may pass segments. source_start and
    source_end say which words each stands for, counts (on the first word of a transcript) how often
    each rule did something.

    A phrase of one word ends where a word holds it; one of several is looked for from each word over
    as many after it. Words then count the matches that ended before them, and those with one count
    meet in one row if a match ends them. All goes by transcript after one shuffle; only words that
    become one are ever in one row.
    """
    slots = _slots(words)
    for k, (find, replace) in enumerate(rules):
        slots = _one_rule(slots.withColumn("find", F.lit(find)).withColumn("replace", F.lit(replace)), k, find.count(" "))
    return _told(slots, len(rules))


def corrected_words_each(words: DataFrame, rules: DataFrame) -> DataFrame:
    """words after the rules of their own transcript (rules: transcript_id, scope_rank, rule_index, find, replace), in order, as corrected_words.

    A round for each place in the longest list of rules of one transcript, for all transcripts at
    once. Every few rounds their result is checkpointed, so that plans don't grow with the rules.
    """
    order = Window.partitionBy("transcript_id").orderBy("scope_rank", "rule_index")
    ranked = rules.select("transcript_id", "find", "replace", (F.row_number().over(order) - 1).alias("k"))
    rounds = ranked.groupBy("k").agg(F.max(F.regexp_count("find", F.lit(" "))).alias("more")).orderBy("k").collect()  # a row for each round
    slots = _slots(words)
    for k, more in rounds:
        slots = _one_rule(slots.join(ranked.filter(F.col("k") == k).drop("k"), "transcript_id", "left"), k, more)
        if (k + 1) % ROUNDS == 0:
            slots = checkpointed(slots)
    return _told(slots, len(rounds))
