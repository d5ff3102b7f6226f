"""Findings for a reviewer: doubtful words, times, speakers, terms, spoken addresses and rules."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.functions.text import ascii_lower, term_key, trim_punctuation, trim_space

SEGMENT = ["transcript_id", "segment_index"]


def low_confidence(words: DataFrame, below: float = 0.75) -> DataFrame:
    """Words with a confidence under the limit, compared as floats; without one they aren't."""
    if not 0 <= below <= 1:
        raise ValueError("a confidence is from 0 to 1")
    return words.filter(F.col("confidence") < F.lit(below).cast("float")).select("transcript_id", "word_index", "text", "confidence", "start_ms", "end_ms")


def fallback_timing(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Words of segments of several words that all have just the segment's times."""
    spans = segments.select(*SEGMENT, F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("upto_ms"))
    whole = Window.partitionBy(*SEGMENT)
    same = (F.col("start_ms") == F.col("from_ms")) & (F.col("end_ms") == F.col("upto_ms"))
    met = words.join(spans, SEGMENT).withColumn("all", F.bool_and(same).over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    return met.filter(F.col("all") & (F.col("n") > 1)).select("transcript_id", "word_index", "text", "start_ms", "end_ms")


def speaker_turns(words: DataFrame) -> DataFrame:
    """Segments of several speakers, or of one and words of none: speakers (sorted, by comma), has_unassigned_words."""
    turns = words.groupBy(*SEGMENT).agg(F.array_sort(F.collect_set("speaker")).alias("speakers"), F.bool_or(F.col("speaker").isNull()).alias("has_unassigned_words"))
    n = F.size("speakers")
    return turns.filter((n > 1) | (n > 0) & F.col("has_unassigned_words")).select(*SEGMENT, F.array_join("speakers", ",").alias("speakers"), "has_unassigned_words")


# -- terms -------------------------------------------------------------------------------------

# Least similarity of a word and of code, and the confidence under which code is doubtful.
PROSE, CODE, CODE_CONFIDENCE = 0.82, 0.70, 0.85


def terms(tokens: DataFrame) -> DataFrame:
    """tokens: path, line, place, token, key, authoritative. A row for each key: key, display (first seen), n_evidence, trusted.

    A term is trusted if something authoritative has it, or two other things do.
    """
    other = F.count_if(~F.col("authoritative"))
    return tokens.groupBy("key").agg(F.min_by("token", F.struct("path", "line", "place")).alias("display"), F.count(F.lit(1)).alias("n_evidence"), (F.bool_or("authoritative") | (other >= 2)).alias("trusted"))


def _edits(size: Column, share: float) -> Column:
    """How many edits a form of this length may be away from a word that is similar enough, whichever is longer."""
    return F.floor(size * (1 - share) / share + 1e-6).cast("int")


def _pieces(size: Column, share: float) -> Column:
    """Where a form of this length is cut: one piece more than edits, so that one of them stands unchanged in every similar word."""
    n = _edits(size, share) + 1
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.floor(i * size / n).cast("int").alias("at"), (F.floor((i + 1) * size / n) - F.floor(i * size / n)).cast("int").alias("len")))


# A form with so many edits at most, and a piece so short, is met by deletions instead: texts of five
# letters share pieces of one or two with too many others.
DELETED, SHORT = 3, 3


def _by_deletion(size: Column, share: float) -> Column:
    """Whether forms of this length are met by what is left when letters are taken away."""
    edits = _edits(size, share)
    return edits.between(1, DELETED) & (F.floor(size / (edits + 1)) <= SHORT)


def _less(text: Column, most: Column) -> Column:
    """What is left of a text without some of its letters, of any up to most of them and DELETED: itself too, each once."""

    def without_one(word: Column) -> Column:
        places = F.when(F.char_length(word) > 0, F.sequence(F.lit(1), F.char_length(word))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda n: F.concat(F.substring(word, F.lit(1), n - 1), F.substring(word, n + 1, F.char_length(word))))

    left = level = F.array(text)
    for n in range(DELETED):
        level = F.array_distinct(F.flatten(F.transform(level, without_one)))
        left = F.when(most > n, F.concat(left, level)).otherwise(left)
        level = F.when(most > n, level).otherwise(F.array().cast("array<string>"))
    return left


def _met(observed: DataFrame, forms: DataFrame, share: float) -> DataFrame:
    """Words and the forms that may be similar enough, each pair once: observed, k, key, form.

    By deletions: if a word is so many edits from a form, both give one text when as many letters at
    most are taken from each. By pieces: a form is cut into one piece more than it may have edits;
    words meet those that have one of these pieces, no farther from its place than there may be edits.
    """
    long = F.char_length("k")
    sizes = F.explode(F.sequence(F.ceil(long * share).cast("int"), F.floor(long / share).cast("int"))).alias("size")
    sized = observed.select("observed", "k", sizes)
    few = _by_deletion(F.col("size"), share)
    most = _edits(F.col("size"), share)
    # A word with a letters less is a form of that size with b less: a is known from b, and at most as many.
    rest = F.filter(_less(F.col("k"), most), lambda t: F.char_length(t) <= F.col("size"))
    shorter = sized.filter(few).select("observed", "k", "size", F.lit(-1).alias("i"), F.explode(rest).alias("piece"))
    left = forms.filter(few).select("key", "form", "size", F.lit(-1).alias("i"), F.explode(_less(F.col("form"), most)).alias("piece"))
    cuts = sized.filter(~few).select("observed", "k", "size", F.explode(_pieces(F.col("size"), share)).alias("p"))
    low, high = F.greatest(F.col("p.at") - most, F.lit(0)), F.least(F.col("p.at") + most, F.char_length("k") - F.col("p.len"))
    starts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    spots = F.array_distinct(F.transform(starts, lambda s: F.substring(F.col("k"), s + 1, F.col("p.len"))))
    spelt = cuts.select("observed", "k", "size", F.col("p.i").alias("i"), F.explode(spots).alias("piece"))
    cut = forms.filter(~few).select("key", "form", "size", F.explode(_pieces(F.col("size"), share)).alias("p"))
    cut = cut.select("key", "form", "size", F.col("p.i").alias("i"), F.substring(F.col("form"), F.col("p.at") + 1, F.col("p.len")).alias("piece"))
    return spelt.union(shorter).join(cut.union(left), ["size", "i", "piece"]).select("observed", "k", "key", "form").distinct()


def _best(observed: DataFrame, forms: DataFrame, share: float) -> DataFrame:
    """observed: observed, k (its key). For each spelling the terms with a form that is similar enough: observed, key, score. Each spelling once, however often it was said."""
    longest = F.greatest(F.char_length("k"), F.char_length("form"))
    within = F.floor(longest * (1 - share) + 1e-6).cast("int")
    edits = F.call_function("levenshtein", F.col("k"), F.col("form"), within)
    score = F.lit(1.0).cast("float") - (edits / longest).cast("float")
    return _met(observed, forms, share).withColumn("edits", edits).filter("edits >= 0").withColumn("score", score).filter(F.col("score") >= F.lit(share).cast("float")).groupBy("observed", "key").agg(F.max("score").alias("score"))


def term_candidates(words: DataFrame, known: DataFrame, below: float = 0.75) -> DataFrame:
    """words: transcript_id, word_index, text, confidence. Words that look like a misheard term, with the best term for each.

    candidate_index, word_index, observed, proposed, confidence, score.
    """
    order = Window.partitionBy("transcript_id").orderBy("word_index")
    given = words.select("transcript_id", "word_index", "text", "confidence", trim_punctuation(F.lag("text").over(order)).alias("previous"))
    code = F.col("text").rlike("[._/]")
    limit = F.lit(below).cast("float")
    doubtful = F.col("confidence").isNull() | (F.col("confidence") < limit) | code & (F.col("confidence") < F.greatest(limit, F.lit(CODE_CONFIDENCE).cast("float")))
    some = given.filter(doubtful).withColumn("code", code).withColumn("observed", trim_punctuation(F.col("text"))).withColumn("k", term_key(F.col("observed"))).filter(F.char_length("k") >= 4)
    whole = known.select("key", F.col("key").alias("form"), F.char_length("key").alias("size"))
    parts = known.select("key", F.explode(F.filter(F.split("display", "[^0-9A-Za-z]"), lambda p: p != "")).alias("form")).withColumn("size", F.char_length("form"))
    spelt = some.select("observed", "k", "code").distinct()
    prose = _best(spelt.filter(~F.col("code")), whole, PROSE).withColumn("code", F.lit(False))
    coded = _best(spelt.filter("code"), whole.union(parts), CODE).withColumn("code", F.lit(True))
    scored = prose.union(coded).join(known, "key")
    first = Window.partitionBy("observed", "code").orderBy(F.desc("score"), F.desc("n_evidence"), "key", "display")
    best = scored.withColumn("n", F.row_number().over(first)).filter("n = 1").filter(F.col("trusted") & (term_key(F.col("observed")) != F.col("key")))
    found = some.join(best.select("observed", "code", "display", "score"), ["observed", "code"])
    head = F.split("display", r"\.")[0]
    joined = (head != "") & (ascii_lower(F.col("previous")) == ascii_lower(head)) & F.col("display").contains(".") & trim_space(F.col("text")).startswith(".")
    joined = F.coalesce(joined, F.lit(False))
    return found.select(
        "transcript_id", (F.col("word_index") - joined.cast("int")).alias("candidate_index"), "word_index",
        F.when(joined, F.concat_ws(" ", "previous", "text")).otherwise(F.col("text")).alias("observed"), F.col("display").alias("proposed"), "confidence", "score",
    )


# -- spoken addresses --------------------------------------------------------------------------

# Tokens are joined by a mark; a blank token leaves two marks in a row. The groups are possessive:
# what has once been read as part of an address isn't given back.
_M, _C = "\x1f", "[A-Za-z0-9-]+"
_DOTTED = rf"(?:{_M}\.{_C}\.*(?={_M}|$)|{_M}(?i:dot){_M}{_C}\.*(?={_M}|$))"
_SLASH = rf"{_M}(?:(?i:slash)|/)(?={_M}|$)"
_SEGMENT = rf"{_M}{_C}\.*(?={_M}|$){_DOTTED}*+"
_ADDRESS = re.compile(rf"(?P<host>{_C}(?={_M}){_DOTTED}++)(?!{_M}(?:{_M}|$))(?P<path>{_SLASH}{_SEGMENT}(?:{_SLASH}{_SEGMENT})*+(?:{_SLASH})?+)?+")
# What is trimmed from a spoken token, and words that an address may follow.
_EDGE = "\"'`()[]{}<>,;:!?"
_BEFORE = {"visit", "open", "at", "on", "website", "url", "link"}


def _plain(tokens: list[str], slashes: bool) -> str:
    """An address as written: dots between components, slashes between segments."""
    out = ""
    for n, token in enumerate(tokens):
        if slashes and token.lower() in ("slash", "/"):
            out += "/"
        elif token.lower() == "dot" and 0 < n < len(tokens) - 1 and not out.endswith(("/", ".")):
            out += "."
        else:
            out += token.rstrip(".")
    return out.rstrip("/")


def spoken_addresses(texts: list[str]) -> list[tuple[int, int, str]]:
    """Addresses among words: (first, last, as written), from the left, none over another."""
    tokens = [t.strip(_EDGE) for t in texts]
    begin, at = [], 0
    for t in tokens:
        begin.append(at)
        at += len(t) + 1
    joined = _M.join(tokens)
    lower = [t.lower() for t in tokens]
    found, n = [], 0
    while n < len(tokens):
        led = lower[n] == "www" or n > 0 and (lower[n - 1] in _BEFORE or n > 1 and lower[n - 2 : n] == ["go", "to"])
        hit = _ADDRESS.match(joined, begin[n]) if led else None
        if hit:
            host, path = (hit[g] or "" for g in ("host", "path"))
            name = _plain(host.split(_M), False).lower()
            if len(name.rsplit(".", 1)[-1]) >= 2:
                last = n + hit[0].count(_M)
                found.append((n, last, name + (_plain(path[1:].split(_M), True) if path else "")))
                n = last
        n += 1
    return found


def _addresses(texts: pd.Series, before: pd.Series) -> pd.Series:
    """Addresses in each list of words that don't begin among the first so many, which are there to be looked back at."""
    found = [[(a, b, url) for a, b, url in spoken_addresses([t or "" for t in list_]) if a >= n] for list_, n in zip(texts, before, strict=True)]
    return pd.Series([[{"first": a, "last": b, "url": url} for a, b, url in rows] for rows in found])


def spoken_urls(words: DataFrame) -> DataFrame:
    """words: transcript_id, word_index, text, confidence. word_index, observed, proposed, confidence (least) of each spoken address.

    An address is a word and those right after it that join on: with a dot before them, as "dot" or
    "slash", or after one of these. Such a run, with the words that stand around it, is all that
    goes to Python, and no run is a part of another's address.
    """
    order = Window.partitionBy("transcript_id").orderBy("word_index")
    edge = re.escape(_EDGE)
    words = words.withColumn("text", F.coalesce("text", F.lit("")))
    token = F.lower(F.regexp_replace("text", f"^[{edge}]+|[{edge}]+$", ""))
    open_ = token.isin("dot", "slash", "/")
    joins = open_ | token.rlike(rf"^\.{_C}\.*$") | F.coalesce(F.lag(open_).over(order), F.lit(False))
    marked = words.select("transcript_id", "word_index", "text", "confidence", joins.alias("joins"))
    near = [F.lag("text", 2).over(order).alias("back2"), F.lag("text", 1).over(order).alias("back1"), F.lead("text", 1).over(order).alias("ahead")]
    run = F.sum((~F.col("joins")).cast("int")).over(order)
    placed = marked.withColumn("run", run).select("*", *near, F.lead("joins").over(order).alias("next_joins"))
    some = placed.filter(F.col("joins") | F.coalesce("next_joins", F.lit(False)))
    row = F.struct("word_index", "text", "confidence", "back2", "back1", "ahead")
    runs = some.groupBy("transcript_id", "run").agg(F.array_sort(F.collect_list(row)).alias("w"))
    back = F.filter(F.array(F.col("w")[0]["back2"], F.col("w")[0]["back1"]), lambda t: t.isNotNull())
    ahead = F.filter(F.array(F.element_at("w", -1)["ahead"]), lambda t: t.isNotNull())
    spread = runs.select("transcript_id", "w", F.size(back).alias("n"), F.concat(back, F.transform("w", lambda x: x["text"]), ahead).alias("texts"))
    found = F.pandas_udf(_addresses, "array<struct<first:int,last:int,url:string>>")
    met = spread.withColumn("found", found("texts", "n")).select("transcript_id", "w", "n", "texts", F.explode("found").alias("f"))
    own = F.slice("texts", F.col("f.first") + 1, F.col("f.last") - F.col("f.first") + 1)
    least = F.array_min(F.transform(F.slice("w", F.col("f.first") - F.col("n") + 1, F.col("f.last") - F.col("f.first") + 1), lambda x: x["confidence"]))
    return met.select("transcript_id", F.get("w", F.col("f.first") - F.col("n"))["word_index"].alias("word_index"), F.array_join(F.transform(own, trim_space), " ").alias("observed"), F.col("f.url").alias("proposed"), least.alias("confidence"))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """All findings in one table: kind, section (its place in parts) and the columns of each, null where it has none."""
    named = [rows.withColumn("kind", F.lit(k)).withColumn("section", F.lit(n)) for n, (k, rows) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def accept_forms(observed: Column, is_url: Column) -> Column:
    """How an accepted finding may be spelt in a text: as it is, without final punctuation, an address also with its parts joined."""
    base = F.regexp_replace(trim_space(observed), "[!-/:-@\\[-`{-~]+$", "")
    joined = F.replace(F.replace(base, F.lit(" ."), F.lit(".")), F.lit(" /"), F.lit("/"))
    return F.array_distinct(F.when(is_url, F.array(base, joined)).otherwise(F.array(base)))
