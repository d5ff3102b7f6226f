"""Whole runs over many transcripts: process, correct, review, accept, verify, and what a batch is told.

Each takes tables and gives tables; a transcript's rules are the rows of a table with its id. What
is to lie on disk is a table of artifacts, and of receipts that commit them: write these last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionlake.functions.text import ascii_lower
from captionlake.operators import attest, batches, captions, render, review, rules
from captionlake.shared import checkpointed

FORMATS = ("srt", "vtt")


def formats_of(wanted: Column) -> Column:
    """A list of subtitle formats, each once, in the order given."""
    return F.array_distinct(F.transform(wanted, F.lower))


def transcript_json(words: DataFrame, segments: DataFrame, language: str = "unknown") -> DataFrame:
    """words and segments of transcripts as sources.transcripts.transcript_files reads them: transcript_id, content. Words are in order, and each segment names its range of them."""
    own = {c: F.col(c) if c in words.columns else F.lit(None).cast(t) for c, t in (("confidence", "float"), ("speaker", "string"))}
    word = F.struct(F.coalesce("text", F.lit("")).alias("text"), "start_ms", "end_ms", *(c.alias(n) for n, c in own.items()))
    said = words.groupBy("transcript_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_index", word.alias("w")))), lambda x: x["w"]).alias("words"), F.max("end_ms").alias("duration_ms"))
    ranges = words.groupBy("transcript_id", "segment_index").agg(F.min("word_index").alias("a"), (F.max("word_index") + 1).alias("b"))
    segment = F.struct("start_ms", "end_ms", "text", F.coalesce("a", F.lit(0)).cast("int").alias("word_start"), F.coalesce("b", F.lit(0)).cast("int").alias("word_end"))
    met = segments.join(ranges, ["transcript_id", "segment_index"], "left").groupBy("transcript_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", segment.alias("s")))), lambda x: x["s"]).alias("segments"))
    whole = met.join(said, "transcript_id", "left")
    none = F.array().cast(said.schema["words"].dataType)
    fields = [F.lit(1).alias("schema_version"), F.lit(language).alias("language"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.coalesce("words", none).alias("words"), "segments"]
    return whole.select("transcript_id", F.to_json(F.struct(*fields)).alias("content"))


def rendered(words: DataFrame, segments: DataFrame, rules_: DataFrame | None = None, policy: captions.Policy = captions.Policy(), formats: tuple[str, ...] = FORMATS) -> tuple[DataFrame, DataFrame]:
    """What corrections change, made anew from words and segments: transcript_id, name, content, counts (for each effective rule, in order); and the rules in that order: transcript_id, find, replace, place.

    transcript.txt has the rules applied to the text. Subtitles are captions of the words after the
    rules, so a phrase matches over lines and captions too.
    """
    none = words.sparkSession.createDataFrame([], f"transcript_id {words.schema['transcript_id'].dataType.simpleString()}, scope_rank long, rule_index long, find string, replace string")
    used = none if rules_ is None else effective(rules_)
    counts = F.coalesce("counts", F.array().cast("array<int>")).alias("counts")
    made = rules.corrected_each(render.plain_text(segments), used).select("transcript_id", F.lit("transcript.txt").alias("name"), F.col("text").alias("content"), counts)
    if formats:
        # Read twice, for captions and for counts.
        said = words if rules_ is None else checkpointed(rules.corrected_words_each(words, used))
        shown = captions.captions(said, policy)
        every = segments.select("transcript_id").distinct()
        done = every if rules_ is None else every.join(said.filter(F.col("counts").isNotNull()).select("transcript_id", "counts"), "transcript_id", "left")
        done = done.select("transcript_id", counts if rules_ is not None else F.array().cast("array<int>").alias("counts"))
        made = made.union(render.subtitles(shown, every, formats).join(done, "transcript_id").select("transcript_id", "name", "content", "counts"))
    place = F.row_number().over(review.Window.partitionBy("transcript_id").orderBy("scope_rank", "rule_index")) - 1
    return made, used.select("transcript_id", "find", "replace", place.alias("place"))


def corrections_receipt(made: DataFrame, rules_: DataFrame) -> DataFrame:
    """made and rules_: of rendered. transcript_id, name, content: for each rule what it replaced in each artifact, as JSON."""
    each = made.select("transcript_id", "name", F.posexplode("counts").alias("place", "replacements"))
    applied = F.array_sort(F.collect_list(F.struct(F.col("name").alias("artifact"), F.coalesce("replacements", F.lit(0)).alias("replacements"))))
    counted = each.groupBy("transcript_id", "place").agg(applied.alias("applications"))
    none = F.array().cast("array<struct<artifact:string,replacements:int>>")
    rule = F.struct("place", F.struct("find", "replace", F.coalesce("applications", none).alias("applications")).alias("rule"))
    listed = rules_.join(counted, ["transcript_id", "place"], "left").groupBy("transcript_id").agg(F.transform(F.array_sort(F.collect_list(rule)), lambda r: r["rule"]).alias("rules"))
    return listed.select("transcript_id", F.lit("corrections.json").alias("name"), F.to_json(F.struct(F.lit(2).alias("schema_version"), "rules")).alias("content"))


def process(words: DataFrame, segments: DataFrame, rules_: DataFrame | None = None, policy: captions.Policy = captions.Policy(), formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """words and segments of transcripts; rules_: transcript_id, scope_rank, rule_index, find, replace. transcript_id, name, content of each artifact.

    transcript.json has the words as they are, transcript.txt and the subtitles are corrected, and
    corrections.json tells what each rule did, for transcripts that have rules.
    """
    made, used = rendered(words, segments, rules_, policy, formats)
    kept = transcript_json(words, segments).select("transcript_id", F.lit("transcript.json").alias("name"), "content").union(made.select("transcript_id", "name", "content"))
    return kept if rules_ is None else kept.union(corrections_receipt(made, used))


def effective(rules_: DataFrame) -> DataFrame:
    """Of each transcript's rules for one phrase the last of the narrowest scope, at its own place."""
    order = F.struct("scope_rank", "rule_index")
    last = rules_.groupBy("transcript_id", ascii_lower(F.col("find")).alias("_k")).agg(F.max(order).alias("_last"))
    met = rules_.withColumn("_k", ascii_lower(F.col("find"))).join(last, ["transcript_id", "_k"])
    return met.filter(order == F.col("_last")).drop("_k", "_last")


def receipts(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """artifacts: transcript_id, name, content; runs: receipt_id (the transcript), mode, source, stages, providers. receipt_id, json: written last, they say that the rest is whole."""
    hashed = artifacts.select(F.col("transcript_id").alias("receipt_id"), F.col("name").alias("path"), F.sha2("content", 256).alias("digest"))
    return attest.made_receipts(runs, hashed)


def correct(artifacts: DataFrame, rules_: DataFrame, dry_run: bool = False) -> DataFrame:
    """artifacts: transcript_id, name, content (text). The same after the transcript's effective rules, with replacements: how many. A dry run has no content."""
    done = rules.corrected_each(artifacts, effective(rules_), text_col="content")
    total = F.aggregate("counts", F.lit(0), lambda a, c: a + F.coalesce(c, F.lit(0))).cast("long")
    told = done.select("transcript_id", "name", "content", total.alias("replacements"))
    return told.drop("content") if dry_run else told


def review_report(words: DataFrame, segments: DataFrame, known: DataFrame | None = None, rules_: DataFrame | None = None, below: float = 0.75) -> DataFrame:
    """All findings of each transcript in the order in which a reviewer reads them: transcript_id, place, kind, candidate_id, segment_index, word_index, observed, proposed, confidence.

    First by words: low confidence, spoken addresses, misheard terms; then segment by segment its
    times and its speakers; then rules that match nothing and rules of one scope against another.
    known: terms as review.terms gives them; rules_: the transcripts' rules.
    """
    where = words.select("transcript_id", "word_index", "segment_index")
    shape = lambda rows, kind, section, **more: rows.select(
        "transcript_id", F.lit(kind).alias("kind"), F.lit(section).alias("section"), *(more.get(c, F.lit(None)).cast(t).alias(c) for c, t in _SHAPE.items()),
    )
    low = review.low_confidence(words, below)
    found = shape(low, "low-confidence", 0, first=F.col("word_index"), word_index=F.col("word_index"), observed=F.col("text"), confidence=F.col("confidence"))
    urls = review.spoken_urls(words)
    found = found.union(shape(urls, "spoken-url", 1, first=F.col("word_index"), word_index=F.col("word_index"), observed=F.col("observed"), proposed=F.col("proposed"), confidence=F.col("confidence"), candidate_id=_candidate("url", "word_index", "proposed")))
    if known is not None:
        terms = review.term_candidates(words, known, below)
        found = found.union(shape(terms, "term-mismatch", 2, first=F.col("word_index"), word_index=F.col("word_index"), observed=F.col("observed"), proposed=F.col("proposed"), confidence=F.col("confidence"), candidate_id=_candidate("term", "candidate_index", "proposed")))
    timing = review.fallback_timing(words, segments).join(where, ["transcript_id", "word_index"])
    found = found.union(shape(timing, "possible-fallback-timing", 3, first=F.col("segment_index"), second=F.lit(0), third=F.col("word_index"), segment_index=F.col("segment_index"), word_index=F.col("word_index"), observed=F.col("text")))
    turns = review.speaker_turns(words)
    found = found.union(shape(turns, "ambiguous-speaker-turn", 3, first=F.col("segment_index"), second=F.lit(1), segment_index=F.col("segment_index"), observed=F.col("speakers")))
    if rules_ is not None:
        unmatched = rules.unmatched_each(render.plain_text(segments), effective(rules_))
        found = found.union(shape(unmatched, "unmatched-rule", 4, first=F.col("scope_rank"), second=F.col("rule_index"), observed=F.col("find"), proposed=F.col("replace")))
        conflicts = rules.conflicts(rules_, "transcript_id")
        found = found.union(shape(conflicts, "scope-conflict", 5, first=F.col("scope_rank"), second=F.col("rule_index"), observed=F.col("shadowed"), proposed=F.col("winner")))
    order = F.row_number().over(review.Window.partitionBy("transcript_id").orderBy("section", "first", "second", "third", "observed", "proposed"))
    return found.withColumn("place", (order - 1).cast("long")).drop("section", "first", "second", "third")


_SHAPE = {"first": "long", "second": "long", "third": "long", "candidate_id": "string", "segment_index": "long", "word_index": "long", "observed": "string", "proposed": "string", "confidence": "float"}


def _candidate(kind: str, index: str, proposed: str) -> Column:
    """A name for a finding that lasts as long as its place and what is proposed do."""
    return F.concat_ws("-", F.lit(kind), F.col(index), F.substring(F.sha2(F.col(proposed), 256), 1, 12))


def accept(report: DataFrame, chosen: DataFrame, manifest: DataFrame) -> DataFrame:
    """report: of review_report; chosen: transcript_id, candidate_id; manifest: transcript_id, find, replace, as it is. What to append: transcript_id, candidate_id, find, replace, outcome (added, present, conflict, unknown)."""
    met = chosen.join(report.filter(F.col("candidate_id").isNotNull()).select("transcript_id", "candidate_id", "kind", "observed", "proposed"), ["transcript_id", "candidate_id"], "left")
    forms = review.accept_forms(F.col("observed"), F.col("kind") == "spoken-url")
    spread = met.select("transcript_id", "candidate_id", F.col("proposed").alias("replace"), F.explode_outer(F.when(F.col("kind").isNotNull(), forms)).alias("find"))
    known = manifest.groupBy("transcript_id", ascii_lower(F.col("find")).alias("k")).agg(F.min("replace").alias("known"))
    told = spread.withColumn("k", ascii_lower(F.col("find"))).join(known, ["transcript_id", "k"], "left")
    same = ascii_lower(F.col("known")) == ascii_lower(F.col("replace"))
    outcome = F.when(F.col("find").isNull(), "unknown").when(F.col("known").isNull(), "added").when(same, "present").otherwise("conflict")
    return told.select("transcript_id", "candidate_id", "find", "replace", outcome.alias("outcome"))


def verify(raw: DataFrame, actual: DataFrame) -> DataFrame:
    """raw: receipt_id, json, is_file; actual: receipt_id, path, digest, is_file, and algorithm (SHA-256 where there is no such column; a file may have a row for each). What is wrong with each run: receipt_id, path, problem. A receipt that can't be read, or is invalid, is its only finding."""
    read = attest.read_receipts(raw)
    unread = read.filter(F.col("error").isNotNull()).select("receipt_id", F.lit(None).cast("string").alias("path"), F.col("error").alias("problem"))
    invalid = attest.receipt_errors(read)
    sound = read.join(invalid.select("receipt_id").distinct(), "receipt_id", "left_anti")
    tracked = attest.tracked_files(sound)
    algorithm = F.col("algorithm") if "algorithm" in actual.columns else F.lit("sha256")
    there = actual.select("receipt_id", "path", algorithm.alias("algorithm"), F.col("digest").alias("found"), F.col("is_file").alias("regular"))
    problem = F.when(F.col("regular").isNull(), "missing").when(~F.col("regular"), "not-a-file").when(F.lower("digest") != F.lower("found"), "changed")
    changed = tracked.join(there, ["receipt_id", "path", "algorithm"], "left").select("receipt_id", "path", problem.alias("problem")).filter(F.col("problem").isNotNull())
    return unread.union(invalid.select("receipt_id", F.lit(None).cast("string"), "error")).union(changed)


def resumed(journals: DataFrame, receipts_: DataFrame) -> DataFrame:
    """journals: of batches.read_journals; receipts_: batch_id, position, attempt, is_valid. Items to run again, in their order, after receipts have settled what they can."""
    return batches.resume_plan(batches.reconciled(batches.items_of(journals), receipts_))


def planned(inputs: DataFrame, workspaces: DataFrame, rules_: DataFrame) -> DataFrame:
    """inputs: position, source; workspaces: workspace, source; rules_: workspace and more. For each input, in its place: the workspace, if it has just one, and how many rules wait there."""
    found = attest.located(inputs, workspaces)
    waiting = rules_.groupBy("workspace").agg(F.count(F.lit(1)).alias("rules"))
    return inputs.join(found, "source", "left").join(waiting, "workspace", "left").select("position", "source", "workspace", F.coalesce("rules", F.lit(0)).alias("rules"))


def batch_table(journals: DataFrame, leases: DataFrame) -> DataFrame:
    """Each journal in the order of a listing: scope, place, path, batch_id, complete, incomplete, activity, error."""
    counted = batches.counts(batches.items_of(journals))
    told = batches.listed(journals).withColumnRenamed("id", "batch_id").join(counted, "batch_id", "left").join(batches.activity(counted, leases), "batch_id", "left")
    fine = F.col("error").isNull()
    return told.select("scope", "place", "path", *(F.when(fine, F.col(c)).alias(c) for c in ("batch_id", "complete", "incomplete", "activity")), "error")


def report_json(rows: DataFrame, key: str, order: str, version: int) -> DataFrame:
    """key, json: the rows of each key, in order, as one versioned report."""
    row = F.struct(F.col(order).alias("_"), F.struct(*(c for c in rows.columns if c != key)).alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"])
    return rows.groupBy(key).agg(listed.alias("diagnostics")).select(key, F.to_json(F.struct(F.lit(version).alias("schema_version"), "diagnostics")).alias("json"))
