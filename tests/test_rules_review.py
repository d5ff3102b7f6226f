"""Rules on texts and words, findings, terms and spoken addresses."""

import random

from captionlake.operators import review as V
from captionlake.operators import rules as R
from captionlake.sources import files as S

RULES = "scope_rank int, rule_index int, find string, replace string"
WORDS = "transcript_id long, segment_index long, word_index long, text string, start_ms long, end_ms long, confidence float, speaker string"


def test_chain_counts_and_unmatched(spark):
    texts = spark.createDataFrame([(1, "foo and doughnut"), (2, "nothing"), (3, None)], "id int, text string")
    rules = [("foo", "X"), ("X and", "Z"), ("dough", "D"), ("Z doughnut", "done")]
    got = {r.id: (r.text, r.counts) for r in R.corrected(texts, rules).collect()}
    assert got[1] == ("done", [1, 1, 0, 1]) and got[2] == ("nothing", [0, 0, 0, 0]) and got[3][0] is None
    assert {(r.rule_index, r.replacements) for r in R.replacement_counts(R.corrected(texts, rules), rules).collect()} == {(0, 1), (1, 1), (2, 0), (3, 1)}
    # Each by itself on the text as it was: the last rule fires, but matches nothing there.
    assert [r.rule_index for r in R.unmatched(texts, rules).orderBy("rule_index").collect()] == [1, 2, 3]
    assert R.corrected(texts, []).filter("size(counts) = 0").count() == 3


def test_scopes(spark):
    rows = spark.createDataFrame([(0, 0, "x", "1"), (0, 1, "x", "2"), (0, 2, "X", "3"), (1, 0, "y", "1"), (2, 0, "y", "1")], RULES)
    assert {(r.find, r.replace, r.scope_rank) for r in R.winners(rows).collect()} == {("X", "3", 0), ("y", "1", 2)}
    assert {(r.find, r.winner, r.shadowed) for r in R.conflicts(rows).collect()} == {("x", "3", "1"), ("X", "3", "2")}
    back = spark.createDataFrame([(0, 0, "x", "1"), (0, 1, "x", "2"), (0, 2, "x", "1")], RULES)
    assert {(r.winner, r.shadowed) for r in R.conflicts(back).collect()} == {("1", "2")}


def literal(texts, ends, rules):
    """Each start and end tried in turn."""
    texts, ends = list(texts), list(ends)
    counts = [0] * len(rules)
    for k, (find, replace) in enumerate(rules):
        a = 0
        while a < len(texts):
            for b in range(a, len(texts)):
                whole = " ".join(t.strip() for t in texts[a : b + 1] if t.strip())
                if find in whole:
                    counts[k] += whole.count(find)
                    texts[a], ends[a] = whole.replace(find, replace), ends[b]
                    texts[a + 1 : b + 1] = [""] * (b - a)
                    a = b
                    break
            a += 1
    return texts, ends, counts


def test_words_equal_the_literal_search(spark):
    rng = random.Random(3)
    rows, want = [], {}
    rules = [("a b", "AB"), ("c", "cc"), ("B c", ""), ("b a b", "x y")]
    for t in range(60):
        texts = [rng.choice(["a", "b", "c", "ab", "ca", " ", "", "b."]) for _ in range(rng.randint(1, 14))]
        want[t] = literal(texts, [n * 10 + 9 for n in range(len(texts))], rules)
        rows += [(t, n % 3, n, x, n * 10, n * 10 + 9, None, None) for n, x in enumerate(texts)]
    got = {}
    for r in R.corrected_words(spark.createDataFrame(rows, WORDS), rules).collect():
        got.setdefault(r.transcript_id, []).append(r)
    for t, (texts, ends, counts) in want.items():
        mine = sorted(got[t], key=lambda r: r.word_index)
        assert [r.text.strip() for r in mine] == [x.strip() for x in texts] and [r.end_ms for r in mine if r.text.strip()] == [e for e, x in zip(ends, texts, strict=True) if x.strip()]
        assert mine[0].counts == counts


def test_phrase_over_segments_keeps_its_sources(spark):
    rows = [(1, s, n, t, n * 320, n * 320 + 300, None, None) for n, (s, t) in enumerate([(0, "I"), (0, "am"), (0, "John"), (0, "Dough."), (1, "See"), (1, "open"), (1, "telemetry.")])]
    got = R.corrected_words(spark.createDataFrame(rows, WORDS), [("John Dough", "John Doe"), ("open telemetry", "OpenTelemetry")]).filter("text <> ''").collect()
    assert [(r.text, r.source_start, r.source_end, r.segment_index) for r in got] == [("I am John Doe. See OpenTelemetry.", 0, 7, 0)]


def test_confidence_timing_and_speakers(spark):
    rows = [
        (1, 0, 0, "a", 0, 100, 0.7, "s0"), (1, 0, 1, "b", 0, 100, 0.75, None), (1, 1, 2, "c", 0, 50, None, None), (1, 1, 3, "d", 0, 100, 0.2, None),
        (1, 2, 4, "e", 0, 100, 0.9, "s1"), (1, 2, 5, "f", 5, 100, 0.9, "s0"),
    ]
    words = spark.createDataFrame(rows, WORDS)
    segments = spark.createDataFrame([(1, s, 0, 100, "x") for s in range(3)], "transcript_id long, segment_index long, start_ms long, end_ms long, text string")
    assert [r.word_index for r in V.low_confidence(words).orderBy("word_index").collect()] == [0, 3]
    assert V.low_confidence(words, 0.7).count() == 1  # 0.7 as a float isn't under 0.7
    assert [r.word_index for r in V.fallback_timing(words, segments).orderBy("word_index").collect()] == [0, 1]
    assert {(r.segment_index, r.speakers, r.has_unassigned_words) for r in V.speaker_turns(words).collect()} == {(0, "s0", True), (2, "s0,s1", False)}


def test_terms(spark):
    files = spark.createDataFrame([("a.md", "use `cargo.toml`, please\nno terms here", True), ("b.txt", "Kubernetes\nKubernetes!", False), ("c.txt", "Singular", False)], "path string, text string, authoritative boolean")
    tokens = S.term_tokens(files)
    assert {(r.path, r.line, r.token) for r in tokens.collect()} == {("a.md", 1, "cargo.toml"), ("b.txt", 1, "Kubernetes"), ("b.txt", 2, "Kubernetes!"), ("c.txt", 1, "Singular")}
    said = [("cargo", 0.99), (".tomo,", 0.7633), ("Kubernetis", 0.3), ("kubernetes", 0.1), ("Singulr", 0.1), ("cube", 0.1), ("kubernetis", 0.9), ("kubernete", None)]
    words = spark.createDataFrame([(1, 0, n, t, 0, 1, c, None) for n, (t, c) in enumerate(said)], WORDS)
    got = {r.word_index: (r.candidate_index, r.observed, r.proposed) for r in V.term_candidates(words, V.terms(tokens)).collect()}
    assert got == {1: (0, "cargo .tomo,", "cargo.toml"), 2: (2, "Kubernetis", "Kubernetes"), 7: (7, "kubernete", "Kubernetes")}


def urls(text):
    return V.spoken_addresses(text.split("|") if "|" in text else text.split())


def test_spoken_addresses():
    assert urls("Visit example .com slash guide.") == [(1, 4, "example.com/guide")]
    assert urls("go to Example dot Com now") == [(2, 4, "example.com")]
    assert urls("www dot example dot org") == [(0, 4, "www.example.org")]
    assert urls("see example dot com") == []
    assert urls("visit example dot c") == []
    assert urls("visit example") == []
    assert urls("open a-b .co .uk. slash X dot Y slash Z") == [(1, 9, "a-b.co.uk/X.Y/Z")]
    assert urls("at site .io slash") == [(1, 2, "site.io")]
    assert urls("at site .io slash a slash") == [(1, 5, "site.io/a")]
    assert urls("at site .io / docs .html next") == [(1, 5, "site.io/docs.html")]
    assert urls("on site|dot|com") == [] and urls("on|site|dot|com") == [(1, 3, "site.com")]
    assert urls("on|site|.com|,|more") == []  # a blank token right after the host
    assert urls("on|site|.com|slash|a|,|b") == [(1, 4, "site.com/a")]
    assert urls("link one .com url two .de") == [(1, 2, "one.com"), (4, 5, "two.de")]
    assert urls("url dot dot com") == [(1, 3, "dot.com")]


def test_spoken_urls_and_report(spark):
    rows = [(1, 0, n, t, 0, 1, c, None) for n, (t, c) in enumerate([("Visit", 0.9), ("example", 0.5), (".com.", 0.4), ("please", 0.1)])] + [(2, 0, 0, "nothing", 0, 1, 0.1, None)]
    words = spark.createDataFrame(rows, WORDS)
    got = V.spoken_urls(words)
    assert [(r.word_index, r.observed, r.proposed, round(r.confidence, 3)) for r in got.collect()] == [(1, "example .com.", "example.com", 0.4)]
    report = V.report({"low-confidence": V.low_confidence(words), "spoken-url": got})
    assert {(r.kind, r.section) for r in report.collect()} == {("low-confidence", 0), ("spoken-url", 1)} and report.count() == 5


def test_spoken_urls_whatever_mark_a_joint_follows(spark):
    joints = [f"{mark}{joint}" for mark in "\"'`()[]{}<>,;:!?" for joint in (".com", "dot")] + [",:.com", ":)DOT"]
    texts = {n: ["visit", "example", joint, *([] if "." in joint else ["com"])] for n, joint in enumerate(joints)}
    rows = [(n, 0, place, t, 0, 1, 0.5, None) for n, words in texts.items() for place, t in enumerate(words)]
    got = {r.transcript_id: (r.word_index, r.proposed) for r in V.spoken_urls(spark.createDataFrame(rows, WORDS)).collect()}
    assert got == {n: (1, "example.com") for n in texts}


def test_spoken_urls_equal_a_scan_of_whole_transcripts(spark):
    rng = random.Random(12)
    pool = ["visit", "go", "to", "www", "at", "site", "a-b", ".com", ".io.", "dot", "Dot", "slash", "/", "docs", "", ",", "x.y", "(dot", "com)", "url", "end."]
    texts = {t: [rng.choice(pool) for _ in range(rng.randint(0, 60))] for t in range(150)}
    rows = [(t, 0, n, w or None, 0, 1, (n % 7) / 8, None) for t, ws in texts.items() for n, w in enumerate(ws)]
    got = sorted((r.transcript_id, r.word_index, r.observed, r.proposed, r.confidence) for r in V.spoken_urls(spark.createDataFrame(rows, WORDS)).collect())
    want = sorted((t, a, " ".join(ws[a : b + 1]), url, min((n % 7) / 8 for n in range(a, b + 1))) for t, ws in texts.items() for a, b, url in V.spoken_addresses(ws))
    assert got == want and len(want) > 100


def test_short_words_meet_by_deletions(spark):
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrst0"
    forms = {"".join(rng.choice(letters) for _ in range(rng.randrange(3, 12))) for _ in range(1500)}
    words = set()
    for form in rng.sample(sorted(forms), 250):
        word = list(form)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        words.add("".join(word))
    words = {w for w in words if len(w) >= 4} | {"aaaa", "aaaaa", "abababa"}
    observed = spark.createDataFrame([(w, w) for w in words], "observed string, k string")
    known = spark.createDataFrame([(f, f, len(f)) for f in forms], "key string, form string, size int")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    for share, most in ((V.PROSE, 4), (V.CODE, 160)):
        near = {(w, f) for w in words for f in forms if abs(len(w) - len(f)) <= 6 and 1 - distance(w, f) / max(len(w), len(f)) >= share - 1e-9}
        assert {(r.observed, r.key) for r in V._best(observed, known, share).collect()} == near
        # How many forms a word is compared with, on average: of 1,500.
        met = V._met(observed, known, share).count() / len(words)
        assert met < most, met
