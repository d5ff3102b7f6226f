"""Queries on whole runs: artifacts, receipts, reviews, journals, discovery and workspaces, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.operators import attest as A
from captionlake.operators import batches as B
from captionlake.operators import review as V
from captionlake.operators import workflow as W
from captionlake.plans import captions as PC
from captionlake.plans import corrections as PX
from captionlake.plans import records as PR
from captionlake.plans import reviews as PV
from captionlake.plans.captions import WORDS
from captionlake.shared import folder
from captionlake.sources import budget as G
from captionlake.sources import files as S
from captionlake.sources import fixtures as X
from captionlake.sources import publish, recordfiles

# -- artifacts and corrections ---------------------------------------------------------------------


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation: "the" in two scopes, the narrower in even ones only, "and", and what never occurs."""
    conv = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transcript_id")).distinct()
    one = lambda keep, scope, n, find, replace: conv.filter(keep).select("transcript_id", F.lit(scope).cast("long").alias("scope_rank"), F.lit(n).cast("long").alias("rule_index"), F.lit(find).alias("find"), replace.alias("replace"))
    i, every = F.col("transcript_id"), F.lit(True)
    parts = [one(every, 0, 0, "the", F.concat(F.lit("teh-"), i.cast("string"))), one(every, 0, 1, "and", F.lit("& $1")), one(i % 2 == 0, 1, 0, "THE", F.lit("and")), one(every, 2, 0, "no such phrase", F.lit("x")), one(i % 2 == 0, 2, 1, "the", F.lit("then"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


def process_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a run makes of every conversation, as digests: the transcript, its corrected text and subtitles, and what each rule did."""
    made = W.process(PC.words(spark, sf_dir), X.conversation_segments(spark, sf_dir), _rules(spark, sf_dir))
    return made.select("transcript_id", "name", F.sha2("content", 256).alias("digest"))


def corrected_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = X.table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    artifacts = turns.select(F.col("conv_id").alias("transcript_id"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("name"), F.col("text").alias("content"))
    return W.correct(artifacts, _rules(spark, sf_dir)).select("transcript_id", "name", F.sha2("content", 256).alias("digest"), "replacements")


def correction_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = X.table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    artifacts = turns.select(F.col("conv_id").alias("transcript_id"), F.col("role").alias("name"), F.col("text").alias("content"))
    return W.correct(artifacts, _rules(spark, sf_dir), dry_run=True).groupBy("transcript_id", "name").agg(F.sum("replacements").alias("replacements"))


def effective_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.effective(_rules(spark, sf_dir))


# -- review ----------------------------------------------------------------------------------------


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are doubtful, flat turns and turns of two speakers as in the queries on each, addresses laid over some words."""
    words, turns = PV._spoken(spark, sf_dir), X.conversation_segments(spark, sf_dir)
    spans = turns.select("transcript_id", "segment_index", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    flat = (F.col("transcript_id") + F.col("segment_index")) % 7 == 0
    words = words.join(spans, ["transcript_id", "segment_index"]).withColumn("start_ms", F.when(flat, F.col("a")).otherwise(F.col("start_ms"))).withColumn("end_ms", F.when(flat, F.col("b")).otherwise(F.col("end_ms")))
    speaker = F.when(F.round(F.col("confidence") * 100) == 3, None).otherwise(F.col("speaker"))
    return W.review_report(words.withColumn("speaker", speaker), turns, None, _rules(spark, sf_dir), 0.05)


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(-1).cast("long")
    return _report(spark, sf_dir).select("transcript_id", "place", "kind", *(F.coalesce(c, none).alias(c) for c in ("segment_index", "word_index")), "observed", "proposed")


def whole_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all words as they are, with terms of the benchmark's texts and the addresses of all pages as one says them; flat turns and words without a speaker as above."""
    words, turns = PV._words(spark, sf_dir), X.conversation_segments(spark, sf_dir)
    spans = turns.select("transcript_id", "segment_index", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    flat = (F.col("transcript_id") + F.col("segment_index")) % 7 == 0
    words = words.join(spans, ["transcript_id", "segment_index"]).withColumn("start_ms", F.when(flat, F.col("a")).otherwise(F.col("start_ms"))).withColumn("end_ms", F.when(flat, F.col("b")).otherwise(F.col("end_ms")))
    words = words.withColumn("speaker", F.when(F.round(F.col("confidence") * 100) == 3, None).otherwise(F.col("speaker")))
    n = F.col("word_index")
    spelt = PV._spelt_pages(spark, sf_dir).select("transcript_id", F.lit(0).cast("long").alias("segment_index"), n, "text", (n * 1000).alias("start_ms"), (n * 1000 + 500).alias("end_ms"), F.lit(1).cast("float").alias("confidence"), F.lit(None).cast("string").alias("speaker"))
    pages = spelt.groupBy("transcript_id", "segment_index").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda w: w["text"]), " ").alias("text"))
    files = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), "text", F.lit(False).alias("authoritative"))
    told = W.review_report(words.select(*spelt.columns).union(spelt), turns.select(*pages.columns).union(pages), V.terms(S.term_tokens(files)), _rules(spark, sf_dir))
    none = F.lit(-1).cast("long")
    return told.select("transcript_id", "place", "kind", *(F.coalesce(c, none).alias(c) for c in ("segment_index", "word_index")), "observed", "proposed")


def accepted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses of a review accepted, into manifests that have them in every third conversation, to another end in every fifth."""
    report = _report(spark, sf_dir)
    chosen = report.filter("kind = 'spoken-url'").select("transcript_id", "candidate_id")
    conv = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transcript_id")).distinct()
    find = " ".join(PV.SPOKEN[1:]).upper().rstrip(",")
    manifest = conv.filter("transcript_id % 3 = 0").select("transcript_id", F.lit(find).alias("find"), F.when(F.col("transcript_id") % 5 == 0, "other").otherwise("EXAMPLE.com/docs/guide.html").alias("replace"))
    told = W.accept(report, chosen, manifest)
    return told.groupBy("transcript_id", "find", "replace", "outcome").agg(F.count(F.lit(1)).alias("n"))


# -- receipts ----------------------------------------------------------------------------------------


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each document, some at fault: the remainder of the id says how."""
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    file = lambda path, digest: F.struct(path.alias("path"), F.struct(F.lit("sha256").alias("algorithm"), digest.alias("value")).alias("digest"))
    own = F.sha2(text, 256)
    named = lambda names, field, value: F.transform(F.array(*map(F.lit, names)), lambda s: F.struct(s.alias("stage"), value(s).alias(field)))
    status = lambda s: F.when((s == "analyze") & (i % 4 == 0), "degraded").when((s == "analyze") & (i % 4 == 2), "skipped").when((s == "render") & (i % 13 == 0), "cached").otherwise("executed")
    full = i % 2 == 0
    provider = lambda s: F.when((s == "extract") & (i % 43 == 0), " ").otherwise("tool")
    stages = F.when(full, named(A.STAGES["full"], "status", status)).otherwise(named(A.STAGES["transcript-only"], "status", status))
    providers = F.when(full & (i % 4 == 0), named([*A.PROVIDED, "normalize", "analyze"], "provider", provider)).when(full, named([*A.PROVIDED, "normalize"], "provider", provider)).otherwise(named(A.PROVIDED, "provider", provider))
    artifacts = F.array(file(F.lit("transcript.json"), own), F.when(i % 31 > 0, file(F.lit("transcript.txt"), F.sha2(F.lower(text), 256))), F.when(i % 17 == 0, file(F.lit("../up.txt"), own)), F.when(i % 59 == 0, file(F.lit("notes.md"), F.lit("short"))))
    json = F.to_json(F.struct(
        F.when(i % 23 == 0, 4).otherwise(3).alias("schema_version"), F.lit("1.0").alias("tool_version"), F.when(full, "full").otherwise("transcript-only").alias("mode"), file(F.concat(F.lit("../"), i.cast("string"), F.lit(".mp4")), own).alias("source"),
        F.filter(artifacts, lambda a: a.isNotNull()).alias("artifacts"), F.when(i % 29 == 0, F.concat(stages, F.slice(stages, 1, 1))).otherwise(stages).alias("stages"),
        F.when(i % 19 == 0, F.slice(providers, 2, 9)).otherwise(providers).alias("providers"),
    ))
    return X.table(spark, sf_dir, "documents").select(i.alias("receipt_id"), F.when(i % 37 == 0, F.substring(json, 1, 50)).otherwise(json).alias("json"), (i % 41 > 0).alias("is_file"))


def receipt_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = A.read_receipts(_receipts(spark, sf_dir))
    return read.filter(F.col("error").isNotNull()).select("receipt_id", "error").union(A.receipt_errors(read))


def receipt_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same receipts as files, each in its run's folder, or a folder where the file should be; what is wrong with those read back."""
    root = f"{folder(spark)}/runs-{uuid.uuid4().hex[:12]}"
    publish.register(spark)
    path = F.concat(F.col("receipt_id"), F.lit("/receipt.json"), F.when(F.col("is_file"), "").otherwise("/other"))
    _receipts(spark, sf_dir).select(path.alias("path"), F.coalesce("json", F.lit("")).cast("binary").alias("content")).write.format("published").mode("append").option("root", root).save()
    # Beside the folders lies what the publication has noted.
    read = A.read_receipts(recordfiles.receipt_files(spark, root).filter("NOT startswith(receipt_id, '.')")).withColumn("receipt_id", F.col("receipt_id").cast("long"))
    return read.filter(F.col("error").isNotNull()).select("receipt_id", "error").union(A.receipt_errors(read))


def artifact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.artifact_count(A.read_receipts(_receipts(spark, sf_dir)).filter(F.col("error").isNull()))


def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts against files of which some are gone, some are folders, and some have a text of other case than recorded."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    path = F.explode(F.array(F.struct(F.concat(F.lit("../"), i.cast("string"), F.lit(".mp4")).alias("path"), text.alias("t")), F.struct(F.lit("transcript.json").alias("path"), text.alias("t")), F.struct(F.lit("transcript.txt").alias("path"), F.when(i % 3 == 0, text).otherwise(F.lower(text)).alias("t")))).alias("f")
    actual = X.table(spark, sf_dir, "documents").select(i.alias("receipt_id"), path).select("receipt_id", "f.path", F.sha2("f.t", 256).alias("digest"), (~((F.col("f.path") == "transcript.json") & (F.col("receipt_id") % 5 == 0))).alias("is_file"))
    actual = actual.filter(~(F.col("path").endswith(".mp4") & (F.col("receipt_id") % 11 == 0)))
    return W.verify(_receipts(spark, sf_dir), actual)


# -- journals ----------------------------------------------------------------------------------------


def _journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal for each user, its items the last digits of the ids of events; some users lack one, so positions have gaps."""
    items = B.latest(PR._log(spark, sf_dir))
    i = F.col("position").cast("int")
    attempt = F.struct(F.when(F.col("batch_id") % 23 == 0, 0).otherwise(i + 1).alias("number"), F.col("at_ms").alias("started_at_ms"), F.when(F.col("state") != "running", F.col("at_ms") + F.when(F.col("batch_id") % 31 == 0, -1).otherwise(1)).alias("finished_at_ms"))
    place = lambda kind: F.concat(F.when(F.col("batch_id") % 29 == 0, "").otherwise("/"), F.lit(kind), i.cast("string"))
    item = F.struct(i.alias("position"), place("in").alias("source"), place("out").alias("workspace"), place("pub").alias("published_base"), F.struct(F.col("state").alias("status"), F.when(F.col("state") != "pending", attempt).alias("attempt")).alias("state"))
    listed = items.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("at_ms").alias("created_at_ms"), F.max("at_ms").alias("updated_at_ms"))
    b = F.col("batch_id")
    scope = F.concat(F.lit("/w"), (b % 6).cast("string"))
    json = F.to_json(F.struct(F.when(b % 13 == 0, 2).otherwise(1).alias("schema_version"), F.concat(F.lit("b"), b.cast("string")).alias("id"), F.lit("1").alias("tool_version"), "created_at_ms", "updated_at_ms", F.when(b % 17 == 0, "/elsewhere").otherwise(scope).alias("cwd"), "items"))
    return listed.select(F.concat(scope, F.lit("/"), F.lpad(b.cast("string"), 6, "0"), F.lit(".json")).alias("path"), scope.alias("scope"), F.when(b % 19 == 0, F.substring(json, 1, 30)).otherwise(json).alias("json"))


def journal_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = B.read_journals(_journals(spark, sf_dir))
    leases = read.filter(F.col("error").isNull() & (F.col("created_at_ms") % 4 == 0)).select(F.col("id").alias("batch_id"))
    listing = W.batch_table(read, leases)
    none = F.lit(-1).cast("long")
    return listing.select("scope", "place", "path", "batch_id", *(F.coalesce(c, none).alias(c) for c in ("complete", "incomplete")), "activity", "error")


def resumed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts prove the items of even positions."""
    read = B.read_journals(_journals(spark, sf_dir))
    items = B.items_of(read)
    proofs = items.filter("attempt is not null").select("batch_id", "position", "attempt", (F.col("position") % 2 == 0).alias("is_valid"))
    return W.resumed(read, proofs).select("batch_id", F.col("position").cast("long").alias("position"), "state")


def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.outcome(B.latest(PR._log(spark, sf_dir))).withColumn("exit_code", F.col("exit_code").cast("long"))


# -- discovery and workspaces --------------------------------------------------------------------------

BUDGET = (300, 6_000_000)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    folder = F.when(i % 11 == 0, ".git/").when(i % 7 == 0, "a/b/c/d/e/").when(i % 5 == 0, "a/b/c/d/").otherwise("")
    ending = F.when(i % 4 == 0, ".md").when(i % 4 == 1, ".TXT").when(i % 4 == 2, ".toml").otherwise(".png")
    path = F.concat(F.lit("/media/"), "lang", F.lit("/"), folder, F.lpad(i.cast("string"), 9, "0"), ending)
    return X.table(spark, sf_dir, "documents").select(F.concat(F.lit("/media/"), "lang").alias("root"), path.alias("path"), (F.col("n_chars").cast("long") * 97).alias("length"))


def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a folder for each language, those that a discovery reads."""
    return G.within_budget(S.term_files(_listed(spark, sf_dir)), *BUDGET).select("root", "path", "length")


def discovered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of documents, by language, then of other transcripts, until there are so many."""
    docs = X.table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select(F.col("lang").alias("root"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), "text")
    turns = X.table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull()).select(F.lit("en").alias("root"), F.format_string("%09d", F.col("conv_id") * 100 + F.col("turn")).alias("path"), "text")
    found = G.within_terms(S.union_of_terms([(docs, True, 3), (turns, False, 0)]), 3000, 20_000)
    return found.groupBy("root", "key").agg(F.min_by("token", F.struct("rank", "path", "line", "place")).alias("display"), F.count(F.lit(1)).alias("n"), F.bool_or("authoritative").alias("authoritative"))


def sibling_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    root = F.concat(F.lit("/m"), (i % 9).cast("string"))
    space = F.concat(root, F.lit("/.cue/w"), i.cast("string"))
    listed = X.table(spark, sf_dir, "pages").select(F.concat(space, F.when(i % 4 == 0, "/summary.md").otherwise("/transcript.txt")).alias("path"), F.coalesce(F.length("html").cast("long") * F.when(i % 5 == 0, 1_000_000).otherwise(1), F.lit(0)).alias("length"), space.alias("workspace"))
    own = listed.groupBy(F.regexp_replace("workspace", "/[^/]+/[^/]+$", "").alias("root")).agg(F.min("workspace").alias("workspace"))
    return S.sibling_files(listed, own).select("root", "path", "length")


def located_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as workspaces: none, one or many of it."""
    docs = X.table(spark, sf_dir, "documents")
    places = docs.filter("doc_id % 40 = 0").select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("workspace"), F.concat("source", F.lit("-"), "lang").alias("source"))
    found = A.located(docs.select(F.concat("source", F.lit("-"), "lang").alias("source")), places)
    return found


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of runs to a lexicon: pages are runs, their addresses rules; manifests of some have changed."""
    pages, i = X.table(spark, sf_dir, "pages"), F.col("page_id")
    rules = pages.select(i.alias("receipt_id"), F.col("url").alias("find"), F.concat(F.lit("page "), i.cast("string")).alias("replace"), F.lit("m").alias("manifest"))
    wanted = pages.select(i.alias("receipt_id"), F.when(i % 6 == 5, "unknown phrase").otherwise(F.upper("url")).alias("find"))
    target = pages.filter("page_id % 4 = 0").groupBy("url").agg(F.min("page_id").alias("p")).select(F.col("url").alias("find"), F.concat(F.lit("page "), (F.col("p") + F.when(F.col("p") % 8 == 0, 0).otherwise(1)).cast("string")).alias("replace"))
    manifests = pages.select(i.alias("receipt_id"), F.concat(F.lit("m"), i.cast("string")).alias("manifest"), F.sha2("url", 256).alias("digest"))
    actual = pages.filter("page_id % 13 > 0").select(F.concat(F.lit("m"), i.cast("string")).alias("manifest"), F.upper(F.sha2(F.when(i % 7 == 0, "changed").otherwise(F.col("url")), 256)).alias("digest"))
    return A.promoted(rules, wanted, target, manifests, actual)


def planned_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as inputs; each third has a workspace, each ninth two; its rules are as many as the last digit of its id."""
    pages = X.table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("source"))
    own = pages.filter("position % 3 = 0").select(F.concat(F.lit("w"), F.col("position").cast("string")).alias("workspace"), "source")
    more = pages.filter("position % 9 = 0").select(F.concat(F.lit("v"), F.col("position").cast("string")).alias("workspace"), "source")
    rules = pages.select(F.concat(F.lit("w"), F.col("position").cast("string")).alias("workspace"), F.explode(F.sequence(F.lit(0), F.col("position") % 10)).alias("n")).filter("n > 0")
    return W.planned(pages, own.union(more), rules)


def memo_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and what is remembered of them: a third of the entries is cut short, a fifth is missing."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    json = F.to_json(F.struct((F.col("doc_id") * 2).alias("n")))
    raw = docs.filter("doc_id % 5 > 0").select("key", F.when(F.col("doc_id") % 3 == 0, F.substring(json, 1, 4)).otherwise(json).alias("json"))
    known, fresh = A.memo_split(docs, A.memo_entries(raw, "n long"))
    return known.select("doc_id", F.col("value.n").alias("n")).union(fresh.select("doc_id", F.lit(-1).cast("long")))


def format_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents")
    wanted = F.array(F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "SRT").otherwise("vtt"), F.lit("srt"), F.col("lang"))
    return docs.select("doc_id", F.array_join(W.formats_of(wanted), ",").alias("formats"))


_PLAIN = """plain AS (SELECT conv_id AS transcript_id, regexp_replace(string_agg(regexp_replace(text, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') || chr(10), '' ORDER BY turn), '\\n+$', chr(10)) AS t
        FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 0 GROUP BY conv_id)"""


def _replaced(source: str, key: str, columns: str) -> str:
    """The effective rules in turn, each in two passes, as adjacent matches share the character between them. Even conversations: "and", then "the"."""
    one = lambda find: rf"'(^|[^\pL\pN])(?i:{find})($|[^\pL\pN])'"
    out, before = [], f"SELECT {columns}, t, 0 AS c FROM {source}"
    for n, (find, replace) in enumerate([("the", f"CASE WHEN {key} % 2 = 0 THEN NULL ELSE 'teh-' || {key} END"), ("and", "'& $1'"), ("the", f"CASE WHEN {key} % 2 = 0 THEN 'then' END")]):
        for k in (0, 1):
            out.append(f"r{n}{k} AS (SELECT {columns}, CASE WHEN {replace} IS NULL THEN t ELSE regexp_replace(t, {one(find)}, '\\1' || {replace} || '\\2', 'g') END AS t, c + CASE WHEN {replace} IS NULL THEN 0 ELSE len(regexp_extract_all(t, {one(find)})) END AS c FROM ({before}))")
            before = f"SELECT * FROM r{n}{k}"
    return ", ".join(out)


def _clock(ms: str, dot: str) -> str:
    return PC._clock(ms, dot)


_CUES = f"""cues AS (SELECT transcript_id, string_agg((caption_index + 1) || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY caption_index) AS srt,
               'WEBVTT' || chr(10) || chr(10) || string_agg({_clock('start_ms', '.')} || ' --> ' || {_clock('end_ms', '.')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY caption_index) AS vtt FROM shown GROUP BY transcript_id)"""
#: The effective rules of each conversation in order: of odd ones "the" first, of even ones last.
_ODD = "{t} % 2 = 1"
_RULES = [(f"CASE WHEN {_ODD} THEN 'the' ELSE 'and' END", f"CASE WHEN {_ODD} THEN 'teh-' || {{t}} ELSE '& $1' END"), (f"CASE WHEN {_ODD} THEN 'and' ELSE 'no such phrase' END", f"CASE WHEN {_ODD} THEN '& $1' ELSE 'x' END"), (f"CASE WHEN {_ODD} THEN 'no such phrase' ELSE 'the' END", f"CASE WHEN {_ODD} THEN 'x' ELSE 'then' END")]
_EACH = PX.BASE.replace("FROM timed", "FROM spoken") + ", " + PX.walked(_RULES, "base")
_QUOTED = "'\"' || replace(replace(replace(replace({}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '\"'"
_JSON = f"""spans AS (SELECT transcript_id, segment_index, min(start_ms) AS a, max(end_ms) AS b, min(word_index) AS lo, max(word_index) + 1 AS hi FROM spoken GROUP BY ALL),
        lists AS (SELECT transcript_id, max(end_ms) AS duration, string_agg('{{"text":' || {_QUOTED.format("text")} || ',"start_ms":' || start_ms || ',"end_ms":' || end_ms || ',"confidence":' || CAST(CAST(percent AS FLOAT) / 100 AS FLOAT) || ',"speaker":' || {_QUOTED.format("speaker")} || '}}', ',' ORDER BY word_index) AS words FROM spoken GROUP BY transcript_id),
        parts AS (SELECT transcript_id, string_agg('{{"start_ms":' || a || ',"end_ms":' || b || ',"text":' || {_QUOTED.format("c.text")} || ',"word_start":' || lo || ',"word_end":' || hi || '}}', ',' ORDER BY segment_index) AS segments
                  FROM spans JOIN conversations c ON c.conv_id = transcript_id AND c.turn = segment_index GROUP BY transcript_id),
        canonical AS (SELECT transcript_id, '{{"schema_version":1,"language":"unknown","duration_ms":' || duration || ',"words":[' || words || '],"segments":[' || segments || ']}}' AS json FROM lists JOIN parts USING (transcript_id)),
        heard AS (SELECT transcript_id, sum(c0) AS n0, sum(c1) AS n1, sum(c2) AS n2 FROM done2 GROUP BY transcript_id),
        put AS (SELECT transcript_id, d0.c AS m0, d1.c - d0.c AS m1, d2.c - d1.c AS m2 FROM r01 d0 JOIN r11 d1 USING (transcript_id) JOIN r21 d2 USING (transcript_id)),
        ordered AS (SELECT transcript_id, CASE WHEN transcript_id % 2 = 1 THEN [m0, m1, 0] ELSE [m1, 0, m2] END AS m FROM put),
        told AS (SELECT transcript_id, '{{"schema_version":2,"rules":[' || list_aggregate(list_transform([1, 2, 3], lambda i: '{{"find":' || [{", ".join(_QUOTED.format("(" + f.format(t="transcript_id") + ")") for f, _ in _RULES)}][i] || ',"replace":' || [{", ".join(_QUOTED.format("(" + r.format(t="transcript_id") + ")") for _, r in _RULES)}][i]
                   || ',"applications":[{{"artifact":"subtitles.srt","replacements":' || [n0, n1, n2][i] || '}},{{"artifact":"subtitles.vtt","replacements":' || [n0, n1, n2][i] || '}},{{"artifact":"transcript.txt","replacements":' || m[i] || '}}]}}'), 'string_agg', ',') || ']}}' AS json
                 FROM ordered JOIN heard USING (transcript_id))"""
_TOLD = " ".join(PV.SPOKEN[1:])
_REPORT = f"""{WORDS}, n AS (SELECT *, count(*) OVER w AS n, min(start_ms) OVER w AS a, max(end_ms) OVER w AS b, (transcript_id + segment_index) % 7 = 0 AS flat FROM timed WINDOW w AS (PARTITION BY transcript_id, segment_index)),
    spoken AS (SELECT *, CASE WHEN place % {PV.EVERY} < {len(PV.SPOKEN)} AND place - place % {PV.EVERY} + {len(PV.SPOKEN)} < n THEN [{", ".join(f"'{w}'" for w in PV.SPOKEN)}][place % {PV.EVERY} + 1] WHEN regexp_matches(text, '(?i)^[\\s.]*(visit|open|at|on|website|url|link|www)\\W*$') THEN '-' ELSE text END AS said FROM n),
    plain AS (SELECT conv_id AS transcript_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
    rules AS (SELECT DISTINCT conv_id AS transcript_id, unnest([{{'s': 0, 'i': 1, 'f': 'and', 'r': '& $1'}}, {{'s': 2, 'i': 0, 'f': 'no such phrase', 'r': 'x'}}, {{'s': CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 0 END, 'i': CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END, 'f': 'the', 'r': CASE WHEN conv_id % 2 = 0 THEN 'then' ELSE 'teh-' || conv_id END}}]) AS r FROM conversations),
    found AS (
        SELECT transcript_id, 'low-confidence' AS kind, 0 AS section, word_index AS x, 0 AS y, 0 AS z, -1 AS segment_index, word_index, said AS observed, NULL AS proposed FROM spoken WHERE percent < 5
        UNION ALL SELECT transcript_id, 'spoken-url', 1, word_index + 1, 0, 0, -1, word_index + 1, '{_TOLD}', 'example.com/docs/guide.html' FROM n WHERE place % {PV.EVERY} = 0 AND place + {len(PV.SPOKEN)} < n
        UNION ALL SELECT transcript_id, 'possible-fallback-timing', 3, segment_index, 0, word_index, segment_index, word_index, said, NULL FROM spoken WHERE flat AND n > 1
        UNION ALL SELECT transcript_id, 'ambiguous-speaker-turn', 3, segment_index, 1, 0, segment_index, -1, any_value(speaker) FILTER (percent <> 3), NULL FROM n GROUP BY transcript_id, segment_index HAVING bool_or(percent = 3) AND bool_or(percent <> 3)
        UNION ALL SELECT transcript_id, 'unmatched-rule', 4, r.s, r.i, 0, -1, -1, r.f, r.r FROM rules JOIN plain USING (transcript_id) WHERE NOT regexp_matches(t, '(?i)(^|[^\\pL\\pN])' || r.f || '($|[^\\pL\\pN])')
        UNION ALL SELECT DISTINCT conv_id, 'scope-conflict', 5, unnest([1, 2]), unnest([0, 1]), 0, -1, -1, unnest(['teh-' || conv_id, 'and']), 'then' FROM conversations WHERE conv_id % 2 = 0)"""
_FIND = " ".join(PV.SPOKEN[1:]).rstrip(",")
_RECEIPTS = """d AS (SELECT doc_id AS i, coalesce(text, '') AS t FROM documents), ok AS (SELECT * FROM d WHERE i % 37 > 0 AND i % 41 > 0),
    unread AS (SELECT i AS receipt_id, CASE WHEN i % 41 = 0 THEN 'no regular file' ELSE 'no receipt' END AS error FROM d WHERE i % 37 = 0 OR i % 41 = 0),
    bad AS (SELECT i AS receipt_id, unnest(list_filter([
        CASE WHEN i % 23 = 0 THEN 'unsupported version' END, CASE WHEN i % 59 = 0 THEN 'a digest is no SHA-256' END, CASE WHEN i % 17 = 0 THEN 'an artifact''s path is unsafe' END, CASE WHEN i % 31 = 0 THEN 'an artifact is missing' END,
        CASE WHEN i % 29 = 0 THEN 'a stage is there twice' END, CASE WHEN i % 13 = 0 THEN 'a status is not one of its stage''s' END, CASE WHEN i % 43 = 0 THEN 'a provider has no name' END, CASE WHEN i % 19 = 0 THEN 'a provider is missing' END], lambda e: e IS NOT NULL)) AS error FROM ok)"""
_JOURNALS = f"""{PR._LATEST}, j AS (
        SELECT batch_id AS b, min(at_ms) AS created, max(at_ms) AS updated, count(*) AS n, max(position) AS top, min(position) AS low, count(*) FILTER (state = 'complete') AS complete, bool_or(state = 'running') AS running,
               bool_or(state <> 'pending' AND batch_id % 23 = 0) AS zero, bool_or(state NOT IN ('pending', 'running')) AS over FROM latest GROUP BY batch_id),
    k AS (SELECT *, '/w' || b % 6 AS scope, '/w' || b % 6 || '/' || lpad(b::VARCHAR, 6, '0') || '.json' AS path,
               CASE WHEN b % 19 = 0 THEN 'no journal' WHEN b % 13 = 0 THEN 'unsupported version' WHEN b % 29 = 0 THEN 'a path is not absolute' WHEN zero THEN 'an attempt has no number' WHEN b % 31 = 0 AND over THEN 'an item ends before it starts'
                    WHEN top + 1 <> n OR low <> 0 THEN 'positions have a gap' WHEN b % 17 = 0 THEN 'not of this scope' END AS error FROM j)"""
_TOKEN = "trim(raw, '\"''`()[]{}<>,;:')"
_KEY = "translate(regexp_replace({}, '[^0-9A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES = {f.__name__: f for f in (
    process_artifacts, corrected_artifacts, correction_dry_run, effective_rules, review_report, whole_review, accepted_findings, receipt_problems, receipt_folders, artifact_counts, run_findings, journal_listing, resumed_items, batch_outcome, discovered_files, discovered_terms,
    sibling_transcripts, located_workspaces, promotions, planned_inputs, memo_hits, format_lists,
)}
SQL = {
    "process_artifacts": f"""WITH RECURSIVE {WORDS.replace("timed AS", "spoken AS").replace("FROM timed", "FROM spoken").replace("grouped AS", "unused AS")}, {_EACH}, {_PLAIN}, {_replaced('plain', 'transcript_id', 'transcript_id')},
        timed AS (SELECT transcript_id, segment_index, word_index AS place, trim(text) AS text, word_index, start_ms, end_ms FROM done2 WHERE trim(text) <> ''),
        grouped AS {WORDS.partition("grouped AS")[2]}{PC.REPAIRED.removeprefix(WORDS)}, {_CUES}, every AS (SELECT transcript_id FROM plain), {_JSON}
        SELECT transcript_id, 'transcript.txt' AS name, sha256(t) AS digest FROM r21 UNION ALL SELECT transcript_id, 'subtitles.srt', sha256(coalesce(srt, '')) FROM every LEFT JOIN cues USING (transcript_id)
        UNION ALL SELECT transcript_id, 'subtitles.vtt', sha256(coalesce(vtt, 'WEBVTT' || chr(10) || chr(10))) FROM every LEFT JOIN cues USING (transcript_id)
        UNION ALL SELECT transcript_id, 'transcript.json', sha256(json) FROM canonical UNION ALL SELECT transcript_id, 'corrections.json', sha256(json) FROM told""",
    "corrected_artifacts": f"""WITH turns AS (SELECT conv_id AS transcript_id, 'turn-' || turn AS name, text AS t FROM conversations WHERE text IS NOT NULL), {_replaced('turns', 'transcript_id', 'transcript_id, name')}
        SELECT transcript_id, name, sha256(t) AS digest, c::BIGINT AS replacements FROM r21""",
    "correction_dry_run": f"""WITH turns AS (SELECT conv_id AS transcript_id, role AS name, text AS t FROM conversations WHERE text IS NOT NULL), {_replaced('turns', 'transcript_id', 'transcript_id, name')}
        SELECT transcript_id, name, sum(c)::BIGINT AS replacements FROM r21 GROUP BY ALL""",
    "effective_rules": """SELECT DISTINCT conv_id AS transcript_id, r.s AS scope_rank, r.i AS rule_index, r.f AS find, r.r AS replace FROM (SELECT conv_id, unnest([
            {'s': 0::BIGINT, 'i': 1::BIGINT, 'f': 'and', 'r': '& $1'}, {'s': 2::BIGINT, 'i': 0::BIGINT, 'f': 'no such phrase', 'r': 'x'},
            {'s': CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 0 END, 'i': CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END, 'f': 'the', 'r': CASE WHEN conv_id % 2 = 0 THEN 'then' ELSE 'teh-' || conv_id END}]) AS r FROM conversations)""",
    "review_report": f"""WITH {_REPORT} SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY section, x, y, z, observed NULLS FIRST, proposed NULLS FIRST) - 1 AS place, kind, segment_index::BIGINT AS segment_index, word_index::BIGINT AS word_index, observed, proposed FROM found""",
    "whole_review": f"""WITH {_REPORT.replace("found AS (", "laid AS (")}, terms_ AS ({PV.SQL["term_candidates"]}), urls AS ({PV.SQL["spoken_urls"]}), found AS (
            SELECT transcript_id, 'low-confidence' AS kind, 0 AS section, word_index AS x, 0 AS y, 0 AS z, -1 AS segment_index, word_index, text AS observed, NULL AS proposed FROM n WHERE percent < 75
            UNION ALL SELECT transcript_id, 'spoken-url', 1, word_index, 0, 0, -1, word_index, observed, proposed FROM urls
            UNION ALL SELECT transcript_id, 'term-mismatch', 2, word_index, 0, 0, -1, word_index, observed, proposed FROM terms_
            UNION ALL SELECT transcript_id, 'possible-fallback-timing', 3, segment_index, 0, word_index, segment_index, word_index, text, NULL FROM n WHERE flat AND n > 1
            UNION ALL SELECT * FROM laid WHERE kind IN ('ambiguous-speaker-turn', 'unmatched-rule', 'scope-conflict'))
        SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY section, x, y, z, observed NULLS FIRST, proposed NULLS FIRST) - 1 AS place, kind, segment_index::BIGINT AS segment_index, word_index::BIGINT AS word_index, observed, proposed FROM found""",
    "accepted_findings": f"""WITH {_REPORT}, u AS (SELECT transcript_id, count(*) AS n FROM found WHERE kind = 'spoken-url' GROUP BY transcript_id), f AS (SELECT *, unnest(['{_FIND}', '{_FIND.replace(" .", ".").replace(" /", "/")}']) AS find FROM u)
        SELECT transcript_id, find, 'example.com/docs/guide.html' AS replace, CASE WHEN find <> '{_FIND}' OR transcript_id % 3 > 0 THEN 'added' WHEN transcript_id % 5 = 0 THEN 'conflict' ELSE 'present' END AS outcome, n FROM f""",
    "receipt_problems": f"WITH {_RECEIPTS} SELECT * FROM unread UNION ALL SELECT * FROM bad",
    "receipt_folders": f"WITH {_RECEIPTS} SELECT * FROM unread UNION ALL SELECT * FROM bad",
    "artifact_counts": f"WITH {_RECEIPTS} SELECT i AS receipt_id, 1 + CASE WHEN i % 31 > 0 THEN 1 ELSE 0 END + CASE WHEN i % 17 = 0 THEN 1 ELSE 0 END + CASE WHEN i % 59 = 0 THEN 1 ELSE 0 END AS n FROM ok",
    "run_findings": f"""WITH {_RECEIPTS}, sound AS (SELECT * FROM ok WHERE i NOT IN (SELECT receipt_id FROM bad))
        SELECT receipt_id, NULL AS path, error AS problem FROM unread UNION ALL SELECT receipt_id, NULL, error FROM bad UNION ALL SELECT i, '../' || i || '.mp4', 'missing' FROM sound WHERE i % 11 = 0
        UNION ALL SELECT i, 'transcript.json', 'not-a-file' FROM sound WHERE i % 5 = 0 UNION ALL SELECT i, 'transcript.txt', 'changed' FROM sound WHERE i % 3 = 0 AND lower(t) <> t""",
    "journal_listing": f"""WITH {_JOURNALS} SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY error IS NULL DESC, CASE WHEN error IS NULL THEN created END DESC NULLS LAST, CASE WHEN error IS NULL THEN 'b' || b END DESC NULLS LAST, path) - 1 AS place, path,
               CASE WHEN error IS NULL THEN 'b' || b END AS batch_id, CASE WHEN error IS NULL THEN complete ELSE -1 END AS complete, CASE WHEN error IS NULL THEN n - complete ELSE -1 END AS incomplete,
               CASE WHEN error IS NULL THEN CASE WHEN complete = n THEN 'complete' WHEN NOT running THEN 'incomplete' WHEN created % 4 = 0 THEN 'active' ELSE 'interrupted' END END AS activity, error FROM k""",
    "resumed_items": f"""WITH {_JOURNALS} SELECT 'b' || b AS batch_id, position, CASE WHEN state IN ('running', 'complete') THEN 'needs-reprocessing' ELSE state END AS state FROM latest JOIN k ON b = batch_id
        WHERE error IS NULL AND NOT (state IN ('running', 'complete') AND position % 2 = 0)""",
    "batch_outcome": f"WITH {PR._LATEST} SELECT count(*) FILTER (state = 'complete') AS succeeded, count(*) FILTER (state <> 'complete') AS failed, CASE WHEN count(*) FILTER (state <> 'complete') > 0 THEN 1::BIGINT ELSE 0 END AS exit_code FROM latest",
    "discovered_files": f"""WITH RECURSIVE f AS (SELECT '/media/' || lang AS root, '/media/' || lang || '/' || CASE WHEN doc_id % 11 = 0 THEN '.git/' WHEN doc_id % 7 = 0 THEN 'a/b/c/d/e/' WHEN doc_id % 5 = 0 THEN 'a/b/c/d/' ELSE '' END || lpad(doc_id::VARCHAR, 9, '0')
                     || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.toml' ELSE '.png' END AS path, n_chars::BIGINT * 97 AS length FROM documents WHERE doc_id % 11 > 0 AND doc_id % 7 > 0 AND doc_id % 4 < 3),
        g AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS n FROM f WHERE length <= 1000000),
        walk AS (SELECT root, 0::BIGINT AS n, 0::BIGINT AS files, 0::HUGEINT AS bytes, false AS taken FROM (SELECT DISTINCT root FROM g)
                 UNION ALL SELECT w.root, g.n, files + CASE WHEN ok THEN 1 ELSE 0 END, bytes + CASE WHEN ok THEN length ELSE 0 END, ok
                 FROM (SELECT w, g, w.root, files < {BUDGET[0]} AND bytes + g.length <= {BUDGET[1]} AS ok, files, bytes, g.length FROM walk w JOIN g ON g.root = w.root AND g.n = w.n + 1))
        SELECT root, path, length FROM walk JOIN g USING (root, n) WHERE taken""",
    "discovered_terms": f"""WITH src AS (SELECT lang AS root, 0 AS rank, lpad(doc_id::VARCHAR, 9, '0') AS path, text FROM documents WHERE text IS NOT NULL
                     UNION ALL SELECT 'en', 1, p, text FROM (SELECT lpad((conv_id * 100 + turn)::VARCHAR, 9, '0') AS p, text FROM conversations WHERE text IS NOT NULL)),
        lines AS (SELECT root, rank, path, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line_text, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS line FROM src),
        toks AS (SELECT root, rank, path, line, unnest(list_filter(regexp_split_to_array(line_text, '\\s+'), lambda x: x <> '')) AS raw, generate_subscripts(list_filter(regexp_split_to_array(line_text, '\\s+'), lambda x: x <> ''), 1) AS place FROM lines),
        kept AS (SELECT *, {_TOKEN} AS token FROM toks WHERE regexp_matches({_TOKEN}, '[._\\p{{Lu}}]') AND strlen({_TOKEN}) >= 3),
        keyed AS (SELECT *, {_KEY.format('token')} AS key FROM kept),
        sized AS (SELECT * FROM keyed WHERE length(key) >= CASE WHEN rank = 0 THEN 3 ELSE 0 END),
        first AS (SELECT *, min(rank) OVER (PARTITION BY root, path) AS fr FROM sized),
        new AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY root, key ORDER BY rank, path, line, place) = 1 THEN 1 ELSE 0 END AS new, row_number() OVER (PARTITION BY root ORDER BY rank, path, line, place) AS n FROM first WHERE rank = fr),
        cum AS (SELECT *, sum(new) OVER (PARTITION BY root ORDER BY n) AS terms FROM new),
        cut AS (SELECT *, min(terms - new) OVER (PARTITION BY root, rank, path) AS before FROM cum)
        SELECT root, key, arg_min(token, n) AS display, count(*) AS n, bool_or(rank = 0) AS authoritative FROM cut WHERE n <= 20000 AND terms <= 3000 AND before < 3000 GROUP BY root, key""",
    "sibling_transcripts": """WITH l AS (SELECT page_id, '/m' || page_id % 9 AS root, '/m' || page_id % 9 || '/.cue/w' || page_id AS w, coalesce(length(html) * CASE WHEN page_id % 5 = 0 THEN 1000000 ELSE 1 END, 0) AS length FROM pages), o AS (SELECT root, min(w) AS own FROM l GROUP BY root)
        SELECT root, w || '/transcript.txt' AS path, length FROM l JOIN o USING (root) WHERE w <> own AND page_id % 4 > 0 AND length <= 1000000""",
    "located_workspaces": """WITH s AS (SELECT source || '-' || lang AS source, CASE WHEN doc_id % 40 = 0 THEN 'w' || doc_id END AS w FROM documents)
        SELECT source, count(w) AS n, CASE WHEN count(w) = 1 THEN min(w) END AS workspace FROM s GROUP BY source""",
    "planned_inputs": "SELECT page_id AS position, 's' || page_id AS source, CASE WHEN page_id % 3 = 0 AND page_id % 9 > 0 THEN 'w' || page_id END AS workspace, CASE WHEN page_id % 3 = 0 AND page_id % 9 > 0 THEN page_id % 10 ELSE 0 END AS rules FROM pages",
    "memo_hits": "SELECT doc_id, CASE WHEN doc_id % 5 > 0 AND doc_id % 3 > 0 THEN doc_id * 2 ELSE -1 END AS n FROM documents",
    "format_lists": "SELECT doc_id, lower(lang) || CASE WHEN doc_id % 2 = 0 THEN ',srt' ELSE ',vtt,srt' END AS formats FROM documents",
    "promotions": """WITH t AS (SELECT lower(url) AS k, 'page ' || (min(page_id) + CASE WHEN min(page_id) % 8 = 0 THEN 0 ELSE 1 END) AS known FROM pages WHERE page_id % 4 = 0 GROUP BY url)
        SELECT page_id AS receipt_id, CASE WHEN page_id % 6 = 5 THEN 'unknown phrase' ELSE url END AS find, CASE WHEN page_id % 6 < 5 THEN 'page ' || page_id END AS replace,
               CASE WHEN page_id % 13 = 0 OR page_id % 7 = 0 THEN 'changed' WHEN page_id % 6 = 5 THEN 'unknown' WHEN known IS NULL THEN 'added' WHEN known = 'page ' || page_id THEN 'present' ELSE 'conflict' END AS outcome
        FROM pages LEFT JOIN t ON k = lower(url) AND page_id % 6 < 5""",
}
