"""Providers with deterministic stubs, and replies that aren't quite JSON."""

import json
import random

import regex
from pyspark.sql import functions as F

from captionlake.operators import providers as P
from captionlake.operators import render as R
from captionlake.sources import transcripts as T


def test_replies(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', '```json\n{"a": {"b": "}"}}\n```': '{"a": {"b": "}"}}', 'Sure! {"a": "\\"{"} and {"b": 2}': '{"a": "\\"{"}', "no object": None,
        '{"a": 1': None, '{"open": {"a": 1}': None, "```\n{}```": "{}", "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "reply string").select("reply", P.bare_object(F.col("reply")).alias("o")).collect()
    assert {r.reply: r.o for r in rows} == cases | {None: None}


def test_objects_against_a_recursive_pattern(spark):
    whole = regex.compile(r'\{(?:[^{}"]++|"(?:[^"\\]|\\.)*+"|(?R))*+\}', regex.DOTALL)
    rng = random.Random(8)
    texts = {"".join(rng.choice('{{}}""\\ab\n\U0001f600,') for _ in range(rng.randrange(30))) for _ in range(3000)}
    texts |= {'{"a": "' + 'x\\n{' * 50_000 + '"} }', "{" * 3000 + "}" * 3000, "no {" + "x" * 100_000 + '} "', '{"open}'}
    want = {t: (m[0] if (m := whole.match(t, t.find("{"))) else None) if "{" in t else None for t in texts}
    rows = spark.createDataFrame([(t,) for t in texts], "reply string").select("reply", P._first_object(F.when(F.contains("reply", F.lit("{")), F.expr("substring(reply, instr(reply, '{'))"))).alias("o"))
    assert {r.reply: r.o for r in rows.collect()} == want
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_normalizing(spark):
    chunks = spark.createDataFrame([(1, 0, "raw text"), (1, 1, "nothing")], "transcript_id long, chunk_index long, text string")
    reply = lambda prompts: [" done: " + p.split("\n")[1] if "raw" in p else "  " for p in prompts]
    got = {r.chunk_index: (r.text, r.error) for r in P.normalized(chunks, reply).collect()}
    assert got == {0: ("done: raw text", None), 1: ("", "no text came back")}


def test_one_request_or_many(spark):
    def reply(prompts):
        out = []
        for p in prompts:
            title = f"whole of {p.count('--- Partial')}" if "--- Partial" in p else p.split("\n")[0]
            out.append("Here: " + json.dumps({"schema_version": 9, "language": "", "title": title, "topics": [{"start_ms": 0, "end_ms": 5, "title": "t"}], "keywords": ["k"]}))
        return out

    spans = spark.createDataFrame([(1, "en", 0, 0, 1500, "short"), (2, "de", 0, 0, 10, "x" * 30), (2, "de", 1, 10, 20, "y" * 30), (2, "de", 2, 20, 30, "z" * 30)], "transcript_id long, language string, chunk_index long, start_ms long, end_ms long, text string")
    got = {r.transcript_id: r for r in P.analyzed(spans, reply, size=60).collect()}
    assert (got[1].title, got[1].language, got[1].schema_version, got[1].error) == ("Transcript language: en", "en", 1, None)
    assert (got[2].title, got[2].language, got[2].summary, got[2].key_points) == ("whole of 2", "de", "", [])
    analyses = P.analyzed(spans, reply, size=60)
    assert R.description(analyses).filter("transcript_id = 1").first()["markdown"] == "# Transcript language: en\n\n\n\n#k\n\n## Chapters\n\n- 00:00 t\n"
    assert P.read_analysis(spark.createDataFrame([(3, "en", "no")], "transcript_id long, language string, reply string")).first()["error"]
    transcripts = spark.createDataFrame([(1, "en"), (2, "de"), (9, "fr")], "transcript_id long, language string")
    silent = P.analyzed(spans, reply, size=60, transcripts=transcripts).filter("transcript_id = 9").collect()
    assert [(r.title, r.language, r.topics, r.keywords, r.error) for r in silent] == [("Untitled", "fr", [], [], None)]


def test_transcribing(spark):
    stub = lambda paths: [json.dumps({"version": 1, "segments": [{"start": 0, "end": 1, "text": p}]}) for p in paths]
    media = spark.createDataFrame([(1, "a.mp3")], "transcript_id long, path string")
    assert [w.text for w in T.words(T.worker_transcripts(P.transcribed(media, stub))).collect()] == ["a.mp3"]
