"""Readers, chunks, recorded files and batches, in tables and in a stream."""

import json
import random

import duckdb
import pytest

from captionlake.operators import attest as A
from captionlake.operators import batches as B
from captionlake.operators import chunks as K
from captionlake.operators import render as R
from captionlake.operators import workflow as W
from captionlake.plans import reviews
from captionlake.sources import budget as G
from captionlake.sources import files as S
from captionlake.sources import fixtures
from captionlake.sources import transcripts as T
from captionlake.streaming import batch_log


def test_worker_output(spark):
    full = {"version": 1, "language": "en", "duration": 2.0, "new": 1, "segments": [
        {"id": 0, "start": 0.0, "end": 1.0, "text": " hello world, ", "words": [{"word": " hello", "start": 0.1, "end": 0.3105, "probability": 0.9}, {"word": "world,", "start": None, "end": None, "probability": 0.5}]},
        {"id": 1, "start": 1.0, "end": 2.0, "text": "this is it.", "words": []},
        {"id": 2, "start": -1.0, "end": 2.0},
    ]}
    raw = spark.createDataFrame([(1, json.dumps(full)), (2, json.dumps({"version": 2, "segments": []})), (3, "{"), (4, None)], "transcript_id long, json string")
    got = {r.transcript_id: r for r in T.worker_transcripts(raw).collect()}
    assert [(w.text, w.start_ms, w.end_ms) for w in got[1].words] == [("hello", 100, 311), ("world,", 0, 1000), ("this", 1000, 2000), ("is", 1000, 2000), ("it.", 1000, 2000)]
    assert [(s.word_start, s.word_end, s.text) for s in got[1].segments] == [(0, 2, "hello world,"), (2, 5, "this is it."), (5, 5, "")]
    assert got[1].language == "en" and got[1].duration_ms == 2000 and got[1].error is None and got[1].words[3].confidence is None
    assert got[2].error == "unsupported version" and got[2].language == "unknown" and got[3].error and got[4].error
    words = T.words(T.worker_transcripts(raw).filter("error is null")).collect()
    assert [(w.segment_index, w.word_index, w.text) for w in words] == [(0, 0, "hello"), (0, 1, "world,"), (1, 2, "this"), (1, 3, "is"), (1, 4, "it.")]


def test_transcript_files(spark):
    word = {"text": "a", "start_ms": 0, "end_ms": 5, "confidence": 0.5}
    seg = lambda a, b: {"start_ms": 0, "end_ms": 5, "text": "a", "word_start": a, "word_end": b}
    files = {1: {"words": [word], "segments": [seg(0, 1)]}, 2: {"schema_version": 2, "words": [], "segments": []}, 3: {"words": [word], "segments": [seg(0, 2)]}, 4: {"words": [word], "segments": [seg(1, 0)]}, 5: {"words": [word]}, 6: {"words": [{**word, "start_ms": -1}], "segments": []}}
    rows = [(k, json.dumps(v)) for k, v in files.items()] + [(7, "no json")]
    got = {r.transcript_id: r.error for r in T.transcript_files(spark.createDataFrame(rows, "transcript_id long, json string")).collect()}
    assert got == {1: None, 2: "unsupported version", 3: "a segment's words are out of range", 4: "a segment's words are out of range", 5: "words or segments are missing", 6: "a time is negative", 7: "no JSON"}


def test_media_and_manifest_paths(spark, tmp_path):
    probe = {"streams": [{"index": 0, "codec_type": "video", "r_frame_rate": "30000/1001"}, {"index": 1, "codec_type": "audio", "channels": 2}], "format": {"format_name": "mov", "duration": "12.3456"}}
    rows = spark.createDataFrame([("a", json.dumps(probe)), ("b", json.dumps({"format": {"duration": "-1"}})), ("c", json.dumps({"format": {}}))], "path string, json string")
    got = {r.path: r for r in T.media(rows).collect()}
    assert got["a"].duration_ms == 12346 and len(got["a"].audio) == len(got["a"].video) == 1 and got["b"].duration_ms is None and got["c"].duration_ms is None
    assert S.manifest_paths("/w", "/w/a/b") == [("/w/corrections.md", 0), ("/w/a/corrections.md", 1), ("/w/a/b/corrections.md", 2)]
    assert S.manifest_paths("/w", "/x/y") == [("/x/corrections.md", 0), ("/x/y/corrections.md", 1)]
    assert S.manifest_paths("/w", "/w") == [("/w/corrections.md", 0)] and S.manifest_paths("/w", "/w/a", "/r.md") == [("/r.md", 0)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "t.json").write_text('{"words": [],\n "segments": []}')
    (tmp_path / "d" / "n.mp3").write_bytes(b"x")
    assert T.transcript_files(T.read_texts(spark, str(tmp_path))).filter("error is null").count() == 1
    assert S.media_inputs(S.list_files(spark, [str(tmp_path)])).count() == 1
    sizes = spark.createDataFrame([(f"f{n}", 10) for n in range(9)], "path string, length long")
    assert G.within_budget(sizes, max_files=5).count() == 5 and G.within_budget(sizes, max_bytes=35).count() == 3
    with pytest.raises(ValueError):
        S.contributing(S.manifest_rules(spark.createDataFrame([("m", 0, "# only")], "manifest string, scope_rank long, text string")), explicit=True)


def plain_chunks(segments, size):
    out, open_ = [], None
    for a, b, text in segments:
        text = text.strip()
        if not text:
            continue
        if len(text) > size:
            out += [open_] if open_ else []
            open_, piece = None, ""
            for w in text.split():
                if piece and len(piece) + 1 + len(w) > size:
                    out.append((a, b, piece))
                    piece = ""
                piece = f"{piece} {w}" if piece else w
            out.append((a, b, piece))
            continue
        ends, held = text.endswith((".", "!", "?")), len(open_[2]) if open_ else 0
        if open_ and (held + 1 + len(text) > size or ends and held >= size // 2):
            out.append(open_)
            open_ = None
        open_ = (open_[0], b, f"{open_[2]} {text}") if open_ else (a, b, text)
        if ends and len(open_[2]) >= size // 2:
            out.append(open_)
            open_ = None
    return out + ([open_] if open_ else [])


def test_chunks_equal_a_sequential_model(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for t in range(40):
        segments = [(n * 10, n * 10 + 9, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 2, 4, 12]))) + rng.choice(["", ".", " "])) for n in range(rng.randint(1, 12))]
        want[t] = plain_chunks(segments, 24)
        rows += [(t, n, *s) for n, s in enumerate(segments)]
    frame = spark.createDataFrame(rows, "transcript_id long, segment_index long, start_ms long, end_ms long, text string")
    got = {}
    for r in K.chunked(frame, 24).collect():
        got.setdefault(r.transcript_id, []).append((r.chunk_index, r.start_ms, r.end_ms, r.text))
    assert {t: [x[1:] for x in sorted(got.get(t, []))] for t in want} == want
    spans = spark.createDataFrame([(1, n, "x" * k) for n, k in enumerate([3, 3, 9, 2, 2, 0, 7])], "transcript_id long, chunk_index long, text string")
    assert [r.group for r in K.span_groups(spans, 6).orderBy("chunk_index").collect()] == [0, 0, 1, 2, 2, 2, 3]
    topics = spark.createDataFrame([(1, 0, "b", 5, 9), (1, 1, "c", 5, 8), (1, 2, " ", 1, 2), (1, 3, "d", 4, 4)], "transcript_id long, topic_index int, title string, start_ms long, end_ms long")
    assert [(r.start_ms, r.title) for r in R.chapters(topics).collect()] == [(5, "b")]


def receipt(**changes):
    file = lambda path, value="a" * 64, algorithm="sha256": {"path": path, "digest": {"algorithm": algorithm, "value": value}}
    good = {
        "schema_version": 3, "tool_version": "1", "mode": "transcript-only", "source": file("../talk.mp4"), "artifacts": [file("transcript.json"), file("transcript.txt", "B" * 64)], "published_outputs": [], "corrections": [],
        "stages": [{"stage": s, "status": "executed"} for s in A.STAGES["transcript-only"]], "providers": [{"stage": s, "provider": "x"} for s in A.PROVIDED], "batch_attempt": None,
    }
    return json.dumps(good | changes), file


def test_receipts(spark):
    whole, file = receipt()
    stages = lambda **status: [{"stage": s, "status": status.get(s, "executed")} for s in A.STAGES["full"]]
    named = lambda *stages: [{"stage": s, "provider": "x"} for s in stages]
    cases = {
        "good": ({}, set()),
        "full": ({"mode": "full", "stages": stages(extract="cached", normalize="skipped", analyze="degraded"), "providers": named(*A.PROVIDED, "normalize", "analyze")}, set()),
        "no analysis": ({"mode": "full", "stages": stages(analyze="skipped"), "providers": named(*A.PROVIDED, "normalize")}, set()),
        "version": ({"schema_version": 4}, {"unsupported version"}),
        "mode": ({"mode": "other"}, {"unknown mode", "a stage is not of this mode"}),
        "status": ({"mode": "full", "stages": stages(render="cached", inspect="skipped", transcribe="degraded"), "providers": named(*A.PROVIDED, "normalize", "analyze")}, {"a status is not one of its stage's"}),
        "provider": ({"providers": named("inspect", "inspect", "extract", "render") + [{"stage": "analyze", "provider": " "}]}, {"a provider is there twice", "a provider's stage has none", "a provider is missing", "a provider has no name"}),
        "no normalizer": ({"mode": "full", "stages": stages(), "providers": named(*A.PROVIDED)}, {"a provider is missing"}),
        "stages": ({"stages": [{"stage": "inspect", "status": "executed"}] * 2 + [{"stage": "analyze", "status": "cached"}]}, {"a stage is there twice", "a stage is missing", "a stage is not of this mode", "a provider's stage has none", "a provider is missing"}),
        "files": ({"artifacts": [file("transcript.json", "zz"), file("../x"), file("../x"), file("receipt.json")]}, {"a digest is no SHA-256", "an artifact's path is unsafe", "a file is there twice", "an artifact is missing"}),
        "published": ({"schema_version": 1, "published_outputs": [file("/abs.srt"), file("../talk.srt")]}, {"version 1 has no published outputs", "a published path is unsafe"}),
        "attempt": ({"batch_attempt": {"batch_id": "a b", "item_position": 0, "attempt_number": 0}}, {"the batch attempt is invalid"}),
        "early attempt": ({"schema_version": 2, "batch_attempt": {"batch_id": "a", "item_position": 0, "attempt_number": 1}}, {"only version 3 has a batch attempt"}),
        "paths": ({"source": file(""), "corrections": [file("", algorithm="md5")], "tool_version": " "}, {"the source has no path", "a correction has no path", "a digest is no SHA-256", "no tool version"}),
    }
    raw = spark.createDataFrame([(k, receipt(**c)[0], True) for k, (c, _) in cases.items()] + [("link", whole, False), ("cut", whole[:-5], True), ("null", None, True), ("other", "[]", True)], "receipt_id string, json string, is_file boolean")
    read = A.read_receipts(raw)
    assert {r.receipt_id: r.error for r in read.filter("error is not null").collect()} == {"link": "no regular file", "cut": "no receipt", "null": "no receipt", "other": "no receipt"}
    got = {k: set() for k in cases}
    for r in A.receipt_errors(read).collect():
        got[r.receipt_id].add(r.error)
    assert got == {k: want for k, (_, want) in cases.items()}
    assert {r.receipt_id: r.n for r in A.artifact_count(read).collect()}["published"] == 4
    actual = spark.createDataFrame([("good", "../talk.mp4", "A" * 64, True), ("good", "transcript.json", "b" * 64, True), ("good", "transcript.txt", "b" * 64, False)], "receipt_id string, path string, digest string, is_file boolean")
    found = {(r.receipt_id, r.path, r.problem) for r in W.verify(raw.filter("receipt_id in ('good', 'link', 'mode')"), actual).collect()}
    assert found == {("good", "transcript.json", "changed"), ("good", "transcript.txt", "not-a-file"), ("link", None, "no regular file"), ("mode", None, "unknown mode"), ("mode", None, "a stage is not of this mode")}


def test_memo_and_places(spark):
    known, fresh = A.memo_split(spark.createDataFrame([("a",), ("b",), ("b",)], "key string"), spark.createDataFrame([("a", 1)], "key string, value int"))
    assert [r.value for r in known.collect()] == [1] and [r.key for r in fresh.collect()] == ["b"]
    places = A.located(spark.createDataFrame([("s",), ("t",), ("u",)], "source string"), spark.createDataFrame([("w1", "s"), ("w2", "t"), ("w3", "t")], "workspace string, source string"))
    assert {(r.source, r.n, r.workspace) for r in places.collect()} == {("s", 1, "w1"), ("t", 2, None), ("u", 0, None)}
    rules, target = (spark.createDataFrame(x, "find string, replace string") for x in ([("Foo", "bar"), ("x", "y"), ("q", "r")], [("foo", "baz"), ("X", "y")]))
    assert [A.promotable(rules, target, f).first()["outcome"] for f in ("FOO", "x", "q")] == ["conflict", "present", "added"]
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    named = rules.withColumn("receipt_id", A.F.lit(1)).withColumn("manifest", A.F.lit("m"))
    named = named.union(named.withColumn("receipt_id", A.F.lit(2)))
    wanted = of([(1, "FOO"), (1, "x"), (1, "q"), (1, "none"), (2, "q")], "receipt_id int, find string")
    manifests = of([(1, "m", "aa"), (2, "m", "aa"), (2, "gone", "bb")], "receipt_id int, manifest string, digest string")
    told = A.promoted(named, wanted, target, manifests, of([("m", "AA")], "manifest string, digest string")).collect()
    assert {(r.receipt_id, r.find, r.outcome) for r in told} == {(1, "Foo", "conflict"), (1, "x", "present"), (1, "q", "added"), (1, "none", "unknown"), (2, "q", "changed")}
    one = spark.range(1).select(A.memo_key(b=A.F.lit(1), a=A.F.lit("x")).alias("k"), A.memo_key(a=A.F.lit("x"), b=A.F.lit(1)).alias("same"), A.memo_key(2, a=A.F.lit("x"), b=A.F.lit(1)).alias("other")).first()
    assert one.k == one.same != one.other


LOG = "batch_id long, position long, state string, at_ms long, seq long"


def test_batches(spark):
    rows = [(1, 0, "running", 1, 1), (1, 0, "failed", 2, 2), (1, 0, "running", 3, 3), (1, 0, "complete", 4, 4), (1, 1, "complete", 1, 5), (2, 0, "running", 9, 6), (2, 2, "odd", 1, 7)]
    log = spark.createDataFrame(rows, LOG)
    assert {(r.batch_id, r.position): r.state for r in B.latest(log).collect()} == {(1, 0): "complete", (1, 1): "complete", (2, 0): "running", (2, 2): "odd"}
    assert [r.attempt for r in B.attempts(log.filter("batch_id = 1 and position = 0")).orderBy("seq").collect()] == [1, 1, 2, 2]
    assert {(r.batch_id, r.error) for r in B.invalid(log).collect()} == {(2, "unknown state"), (2, "positions have a gap")}
    assert [tuple(r) for r in B.outcome(B.latest(log)).collect()] == [(2, 2, 1)]
    items = spark.createDataFrame([(1, 0, 1, "running"), (1, 1, 1, "complete"), (1, 2, 2, "running"), (1, 3, 1, "failed")], "batch_id long, position long, attempt long, state string")
    receipts = spark.createDataFrame([(1, 0, 1, True), (1, 2, 1, True), (1, 1, 1, False)], "batch_id long, position long, attempt long, is_valid boolean")
    done = B.reconciled(items, receipts)
    assert {r.position: r.state for r in done.collect()} == {0: "complete", 1: "needs-reprocessing", 2: "needs-reprocessing", 3: "failed"}
    assert [r.position for r in B.resume_plan(done).collect()] == [1, 2, 3]


def journal(path, scope="/w", **changes):
    state = lambda status, number=1, start=5, end=9: {"status": status} if status == "pending" else {"status": status, "attempt": {"number": number, "started_at_ms": start, "finished_at_ms": end}}
    item = lambda position, *s, **k: {"position": position, "source": f"/w/{position}", "workspace": f"/w/o{position}", "published_base": f"/w/{position}", "state": state(*s)} | k
    good = {"schema_version": 1, "id": path, "tool_version": "1", "created_at_ms": 10, "updated_at_ms": 20, "cwd": "/w", "corrections": None, "items": [item(0, "complete"), item(1, "running", 2, 5, None), item(2, "pending")]}
    return (path, scope, json.dumps(good | (changes.get("change") or (lambda item: {}))(item)))


def test_journals(spark):
    cases = {
        "a": (None, None),
        "b": (lambda item: {"created_at_ms": 11, "items": [item(0, "complete")]}, None),
        "c": (lambda item: {"schema_version": 2}, "unsupported version"),
        "d": (lambda item: {"id": "no name"}, "no name"),
        "e": (lambda item: {"updated_at_ms": 9}, "updated before it was created"),
        "f": (lambda item: {"items": [item(0, "complete", source="rel")]}, "a path is not absolute"),
        "g": (lambda item: {"items": []}, "no items"),
        "h": (lambda item: {"items": [item(0, "pending"), item(0, "pending")]}, "a position is there twice"),
        "i": (lambda item: {"items": [item(0, "odd")]}, "unknown state"),
        "j": (lambda item: {"items": [item(0, "failed", 0)]}, "an attempt has no number"),
        "k": (lambda item: {"items": [item(0, "running")]}, "a running item is finished"),
        "l": (lambda item: {"items": [item(0, "missing", 1, 5, None)]}, "an item has no end"),
        "m": (lambda item: {"items": [item(0, "failed", 1, 5, 4)]}, "an item ends before it starts"),
        "n": (lambda item: {"items": [item(1, "pending"), item(2, "pending")]}, "positions have a gap"),
        "o": (lambda item: {"cwd": "/other"}, "not of this scope"),
    }
    raw = spark.createDataFrame([journal(k, change=c) for k, (c, _) in cases.items()] + [("p", "/w", "{"), ("q", "/w", None)], "path string, scope string, json string")
    read = B.read_journals(raw)
    assert {r.path: r.error for r in read.collect()} == {k: e for k, (_, e) in cases.items()} | {"p": "no journal", "q": "no journal"}
    leases = spark.createDataFrame([("a",)], "batch_id string")
    listing = W.batch_table(read, leases).orderBy("place").collect()
    assert [(r.path, r.batch_id, r.activity) for r in listing[:3]] == [("b", "b", "complete"), ("a", "a", "active"), ("c", None, None)] and len(listing) == 17
    receipts = spark.createDataFrame([("a", 1, 2, True), ("a", 0, 9, True)], "batch_id string, position int, attempt int, is_valid boolean")
    assert [(r.batch_id, r.position, r.state) for r in W.resumed(read, receipts).collect()] == [("a", 0, "needs-reprocessing"), ("a", 2, "pending"), ("b", 0, "needs-reprocessing")]
    log = spark.createDataFrame([("a", 0, "failed", 0, 5, 4), ("b", 0, "running", 1, 5, 6)], "batch_id string, position int, state string, attempt int, started_at_ms long, finished_at_ms long")
    assert {(r.batch_id, r.error) for r in B.invalid(log).collect()} == {("a", "an attempt has no number"), ("a", "an item ends before it starts"), ("b", "a running item is finished")}


def test_discovery(spark, tmp_path):
    listed = [("/r", f"/r/{p}", n) for p, n in [("a.md", 5), ("a/b/c/d/x.TXT", 5), ("a/b/c/d/e/x.txt", 5), (".git/x.txt", 5), (".env", 5), ("x.env", 5), ("big.py", 1_000_001), ("a.png", 5), ("noend", 5), (".hidden.md", 5)]]
    kept = S.term_files(spark.createDataFrame([*listed, ("/r", "/other/a.md", 5)], "root string, path string, length long"))
    assert {r.path for r in kept.collect()} == {"/r/a.md", "/r/a/b/c/d/x.TXT", "/r/x.env", "/r/.hidden.md"}
    sizes = spark.createDataFrame([("r", p, n) for p, n in [("a", 6), ("b", 5), ("c", 3), ("d", 2), ("d", 2), ("e", 1), ("f", 99)]] + [("s", "a", 10)], "root string, path string, length long")
    assert sorted((r.root, r.path) for r in G.within_budget(sizes, 3, 10).collect()) == [("r", "a"), ("r", "c"), ("r", "e"), ("s", "a")]
    assert sorted((r.path) for r in G.within_budget(sizes.filter("root = 'r'"), 2, 10).collect()) == ["a", "c"]
    files = lambda rows: spark.createDataFrame(rows, "root string, path string, text string")
    terms = S.union_of_terms([(files([("r", "1", "Aaa Bbb Aaa"), ("r", "2", "Ccc Aaa Ddd"), ("r", "3", "Aaa Eee")]), True, 3), (files([("r", "1", "Zzz"), ("r", "9", "A.b Aaa")]), False, 0)])
    assert sorted((r.path, r.token, r.authoritative) for r in terms.filter("path in ('1', '9')").collect()) == [("1", "Aaa", True), ("1", "Aaa", True), ("1", "Bbb", True), ("9", "A.b", False), ("9", "Aaa", False)]
    cut = lambda **k: [r.token for r in G.within_terms(terms, **k).orderBy("rank", "path", "line", "place").collect()]
    assert cut() == ["Aaa", "Bbb", "Aaa", "Ccc", "Aaa", "Ddd", "Aaa", "Eee", "A.b", "Aaa"]
    assert cut(max_evidence=4) == ["Aaa", "Bbb", "Aaa", "Ccc"]
    assert cut(max_terms=3) == ["Aaa", "Bbb", "Aaa", "Ccc", "Aaa"]  # the second file until its new term; the third isn't begun
    assert cut(max_terms=4) == ["Aaa", "Bbb", "Aaa", "Ccc", "Aaa", "Ddd"]
    own = spark.createDataFrame([("/m", "/m/.cue/one")], "root string, workspace string")
    others = spark.createDataFrame([(f"/m/.cue/{w}/{f}", n, f"/m/.cue/{w}") for w in ("one", "two") for f, n in (("transcript.txt", 9), ("summary.md", 9), ("x/transcript.txt", 1_000_001))], "path string, length long, workspace string")
    assert [tuple(r) for r in S.sibling_files(others, own).collect()] == [("/m", "/m/.cue/two/transcript.txt", 9)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("Some Term")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    assert [(r.path, r.text) for r in S.read_term_files(spark, str(tmp_path)).collect()] == [(f"{tmp_path}/a/x.md", "Some Term")]


def test_normalized_files(spark):
    good = json.dumps({"schema_version": 1, "language": "en", "chunks": [{"start_ms": 0, "end_ms": 5, "text": " one "}, {"start_ms": 5, "end_ms": 9, "text": " "}]})
    read = T.normalized_files(spark.createDataFrame([(1, good), (2, '{"schema_version": 2, "chunks": []}'), (3, "{"), (4, "{}")], "transcript_id long, json string"))
    assert {r.transcript_id: r.error for r in read.collect()} == {1: None, 2: "unsupported version", 3: "no JSON", 4: "chunks are missing"}
    assert [tuple(r) for r in T.chunks(read).collect()] == [(1, 0, 0, 5, " one "), (1, 1, 5, 9, " ")]


def test_a_stream_of_changes_goes_on_where_it_ended(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    states = lambda: {(r.position): r.state for r in spark.read.parquet(f"{tmp_path}/out").groupBy("position").agg(B.F.max_by("state", "at_ms").alias("state")).collect()}

    def go():
        changes = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in")
        batch_log.changed_items(changes, f"{tmp_path}/state", f"{tmp_path}/out").awaitTermination()

    write([(1, 0, "running", 1, 1), (1, 1, "running", 2, 2)])
    go()
    assert states() == {0: "running", 1: "running"}
    write([(1, 0, "complete", 3, 3), (1, 1, "pending", 0, 0)])  # an old change comes late
    go()
    assert states() == {0: "complete", 1: "running"}


def test_windows_in_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01 00:10:00' ts, 'view' event_type union all select timestamp'2026-01-01 00:50:00', 'view' union all select timestamp'2026-01-01 09:00:00', 'error'").coalesce(1).write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/e")
    query = batch_log.counted_by_window(events).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert [(r.event_type, r.n) for r in spark.table("counted").collect()] == [("view", 2)]


def test_whole_chunks_have_the_words_of_long_turns(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "w" * rng.randint(1, 12) + rng.choice(["", "", ",", "."])
    turns = [(c, n, "host", " ".join(word() for _ in range(rng.choice([0, 3, 90, 180, 400, 900])))) for c in range(12) for n in range(8)]
    turns += [(12, 0, "host", "x" * 1600), (12, 1, "host", "short"), (12, 2, "host", "a " + "y" * 1500 + " b"), (13, 0, "host", "z" * 1499 + "."), (13, 1, "host", "v " * 750 + "v")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    times = {(r.transcript_id, r.segment_index): (r.start_ms, r.end_ms) for r in fixtures.conversation_segments(spark, str(tmp_path)).collect()}
    want = {(c, n): x for c in range(14) for n, x in enumerate(plain_chunks([(*times.get((t, k), (0, 0)), text) for t, k, _, text in turns if t == c], reviews.CHUNK))}
    got = {(r.transcript_id, r.chunk_index): (r.start_ms, r.end_ms, r.text) for r in reviews.whole_chunks(spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(len(text.split()) for _, _, text in got.values()) == sum(len(text.split()) for *_, text in turns)
    groups, last = {}, None
    for (c, n), (_, _, text) in sorted(want.items()):
        chars, group = last[1:] if last and last[0] == c else (0, 0)
        over = chars > 0 and chars + len(text) > reviews.SPAN
        last = (c, len(text) if over else chars + len(text), group + over)
        groups[c, n] = last[2]
    assert {(r.transcript_id, r.chunk_index): r.group for r in reviews.whole_analysis_spans(spark, str(tmp_path)).collect()} == groups
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r[:2]): tuple(r[2:]) for r in con.execute(reviews.SQL["whole_chunks"]).fetchall()} == want
    assert {tuple(r[:2]): r[2] for r in con.execute(reviews.SQL["whole_analysis_spans"]).fetchall()} == groups
