"""Whole runs over small transcripts: artifacts, receipts, corrections, a review's order and what is accepted."""

import hashlib
import json

from captionlake.operators import attest as A
from captionlake.operators import review as V
from captionlake.operators import rules as R
from captionlake.operators import workflow as W
from captionlake.sources import files as S
from captionlake.sources import transcripts as T

WORDS = "transcript_id long, segment_index long, word_index long, text string, start_ms long, end_ms long, confidence float, speaker string"
SEGMENTS = "transcript_id long, segment_index long, start_ms long, end_ms long, text string"
RULES = "transcript_id long, scope_rank int, rule_index int, find string, replace string"


def said(spark):
    rows, at = [], 0
    for segment, words in enumerate([["Open", "telemetry", "visit", "example", ".com"], ["use", "Kubernetis", "now."]]):
        for w in words:
            rows.append((1, segment, at, w, at * 500, at * 500 + 400, 0.3 if w in ("use", "Kubernetis") else 0.9, "a" if w in ("use", "now.") else "b" if segment else None))
            at += 1
    rows += [(2, 0, 0, "one", 0, 900, None, None), (2, 0, 1, "two", 0, 900, None, None), (3, 0, 0, " ", 0, 0, None, None)]
    segments = [(1, 0, 0, 2400, "Open telemetry visit example .com"), (1, 1, 2500, 3900, "use Kubernetis now."), (2, 0, 0, 900, "one two"), (3, 0, 0, 0, " ")]
    rules = [(1, 0, 0, "open telemetry", "OTel"), (1, 0, 1, "use", "take"), (1, 1, 0, "USE", "employ"), (1, 1, 1, "missing", "x"), (1, 2, 0, "use", "apply"), (2, 0, 0, "one", "1")]
    return spark.createDataFrame(rows, WORDS), spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(rules, RULES)


def test_process_and_receipts(spark):
    words, segments, rules = said(spark)
    got = {(r.transcript_id, r.name): r.content for r in W.process(words, segments, rules).collect()}
    assert len(got) == 14  # four each, and what rules did to two
    assert got[1, "transcript.txt"] == "OTel visit example .com\napply Kubernetis now.\n" and got[2, "transcript.txt"] == "1 two\n"
    assert got[1, "subtitles.srt"].startswith("1\n00:00:00,000 --> ") and got[3, "subtitles.srt"] == "" and got[3, "subtitles.vtt"] == "WEBVTT\n\n"
    assert {n for _, n in ((r.transcript_id, r.name) for r in W.process(words, segments, formats=("vtt",)).collect())} == {"transcript.json", "transcript.txt", "subtitles.vtt"}
    assert spark.range(1).select(W.formats_of(A.F.array(A.F.lit("SRT"), A.F.lit("vtt"), A.F.lit("srt"))).alias("f")).first().f == ["srt", "vtt"]
    runs = [(1, "transcript-only", ("../t.mp4", ("sha256", "c" * 64)), [(s, "executed") for s in A.STAGES["transcript-only"]], [(s, "x") for s in A.PROVIDED])]
    runs = spark.createDataFrame(runs, "receipt_id long, mode string, source struct<path:string,digest:struct<algorithm:string,value:string>>, stages array<struct<stage:string,status:string>>, providers array<struct<stage:string,provider:string>>")
    raw = W.receipts(W.process(words, segments, rules), runs).withColumn("is_file", A.F.lit(True))
    read = A.read_receipts(raw)
    assert A.receipt_errors(read).count() == 0 and [r.n for r in A.artifact_count(read).collect()] == [5]
    tracked = {r.path: r.digest for r in A.tracked_files(read).collect()}
    assert tracked["transcript.txt"] == hashlib.sha256(got[1, "transcript.txt"].encode()).hexdigest()


def test_what_is_processed_is_read_again_and_corrected_by_words(spark):
    words, segments, _ = said(spark)
    rules = spark.createDataFrame([(1, 0, 0, "telemetry visit", "Telemetry, see"), (1, 0, 1, "e", "E"), (2, 0, 0, "none", "x")], RULES)
    got = {(r.transcript_id, r.name): r.content for r in W.process(words, segments, rules).collect()}
    raw = spark.createDataFrame([(t, c) for (t, n), c in got.items() if n == "transcript.json"], "transcript_id long, json string")
    read = T.transcript_files(raw)
    assert read.filter("error is not null").count() == 0
    key = lambda r: (r.transcript_id, r.word_index)
    assert [tuple(r) for r in sorted(T.words(read).collect(), key=key)] == [(r.transcript_id, r.segment_index, r.word_index, r.text, r.start_ms, r.end_ms, r.confidence, r.speaker) for r in sorted(words.collect(), key=key)]
    assert {tuple(r) for r in T.segments(read).collect()} == {tuple(r) for r in segments.collect()}
    # The phrase stands over words; what was before it in the transcript becomes one word with it.
    assert "OpEn TElEmEtry, sEE" in got[1, "subtitles.srt"] and "telemetry" not in got[1, "subtitles.vtt"]
    told = {r["find"]: {a["artifact"]: a["replacements"] for a in r["applications"]} for r in json.loads(got[1, "corrections.json"])["rules"]}
    assert told["telemetry visit"] == {"transcript.txt": 1, "subtitles.srt": 1, "subtitles.vtt": 1}
    assert told["e"]["subtitles.srt"] == told["e"]["subtitles.vtt"] == 11 and told["e"]["transcript.txt"] == 0
    assert json.loads(got[2, "corrections.json"])["rules"] == [{"find": "none", "replace": "x", "applications": [{"artifact": n, "replacements": 0} for n in ("subtitles.srt", "subtitles.vtt", "transcript.txt")]}]


def test_rules_of_each_transcript_equal_those_of_all(spark):
    words, _, _ = said(spark)
    given = [("Open telemetry", "OT"), ("e", "E"), ("sE", "")]
    each = spark.createDataFrame([(t, 0, n, f, r) for t in (1, 2, 3) for n, (f, r) in enumerate(given)], RULES)
    key = lambda rows: sorted((r.transcript_id, r.word_index, r.text, r.end_ms, r.source_start, r.source_end, tuple(r.counts or ())) for r in rows)
    assert key(R.corrected_words_each(words, each).collect()) == key(R.corrected_words(words, given).collect())
    few = each.filter("transcript_id = 1 and rule_index < 2 or transcript_id = 2 and rule_index = 1")
    some = key(R.corrected_words_each(words, few).collect())
    assert [x for x in some if x[0] == 2][0][2] == "onE" and [x for x in some if x[0] == 3][0][2] == " "


def test_correct(spark):
    words, segments, rules = said(spark)
    artifacts = segments.select("transcript_id", A.F.concat(A.F.lit("s"), "segment_index").alias("name"), A.F.col("text").alias("content"))
    done = {(r.transcript_id, r.name): (r.content, r.replacements) for r in W.correct(artifacts, rules).collect()}
    assert done == {(1, "s0"): ("OTel visit example .com", 1), (1, "s1"): ("apply Kubernetis now.", 1), (2, "s0"): ("1 two", 1), (3, "s0"): (" ", 0)}
    dry = W.correct(artifacts, rules, dry_run=True)
    assert dry.columns == ["transcript_id", "name", "replacements"] and sum(r.replacements for r in dry.collect()) == 3
    assert {(r.find, r.replace) for r in W.effective(rules).filter("transcript_id = 1").collect()} == {("open telemetry", "OTel"), ("use", "apply"), ("missing", "x")}


def test_many_rules_equal_few(spark):
    texts = spark.createDataFrame([(1, "a b c a"), (2, None), (3, "zz")], "id long, text string")
    rules = [("a", "b"), ("b", "c"), ("c c", "d"), ("$", "\\\\")]
    few = {r.id: (r.text, r.counts) for r in R.corrected(texts, rules).collect()}
    many = {r.id: (r.text, r.counts[:4]) for r in R.corrected(texts, rules + [(f"none{n}", "x") for n in range(R.CHAINED)]).collect()}
    assert few == many and few[1] == ("d d", [2, 3, 2, 0])


def test_review_order_and_accept(spark):
    words, segments, rules = said(spark)
    terms = V.terms(S.term_tokens(spark.createDataFrame([("a.md", "Kubernetes", True)], "path string, text string, authoritative boolean")))
    report = W.review_report(words, segments, terms, rules)
    got = [(r.kind, r.word_index, r.segment_index, r.observed, r.proposed) for r in report.filter("transcript_id = 1").orderBy("place").collect()]
    assert got == [
        ("low-confidence", 5, None, "use", None), ("low-confidence", 6, None, "Kubernetis", None),
        ("spoken-url", 3, None, "example .com", "example.com"), ("term-mismatch", 6, None, "Kubernetis", "Kubernetes"),
        ("ambiguous-speaker-turn", None, 1, "a,b", None), ("unmatched-rule", None, None, "missing", "x"), ("scope-conflict", None, None, "take", "apply"), ("scope-conflict", None, None, "employ", "apply"),
    ]
    assert [(r.kind, r.word_index) for r in report.filter("transcript_id = 2").orderBy("place").collect()] == [("possible-fallback-timing", 0), ("possible-fallback-timing", 1)]
    ids = {r.kind: r.candidate_id for r in report.filter("candidate_id is not null").collect()}
    assert W.review_report(words, segments, terms, rules).filter(A.F.col("candidate_id") == ids["spoken-url"]).count() == 1
    chosen = spark.createDataFrame([(1, ids["spoken-url"]), (1, ids["term-mismatch"]), (1, "stale")], "transcript_id long, candidate_id string")
    manifest = spark.createDataFrame([(1, "KUBERNETIS", "kubernetes"), (1, "example.com", "other.com")], "transcript_id long, find string, replace string")
    told = {(r.candidate_id, r.find, r.replace, r.outcome) for r in W.accept(report, chosen, manifest).collect()}
    assert told == {(ids["spoken-url"], "example .com", "example.com", "added"), (ids["spoken-url"], "example.com", "example.com", "conflict"), (ids["term-mismatch"], "Kubernetis", "Kubernetes", "present"), ("stale", None, None, "unknown")}
    out = json.loads(W.report_json(report, "transcript_id", "place", 2).filter("transcript_id = 1").first().json)
    assert out["schema_version"] == 2 and [d["kind"] for d in out["diagnostics"]] == [k for k, *_ in got]


def test_empty_tables(spark):
    words, segments, rules = (t.limit(0) for t in said(spark))
    assert W.process(words, segments, rules).count() == W.review_report(words, segments, None, rules).count() == 0
