"""Line dedup and archives against plain versions."""

import base64
import collections
import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from captionlake.llm import line_dedup, warc
from captionlake.llm.queries import SQL

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, min_chars, min_docs):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            held = holders.get(key(line), set())
            ids = [h for h in held if h is not None]
            if len(held) < min_docs or i == (max(ids) if ids else None):
                stay.append(line)
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return collections.Counter(out)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    pool = [f"A line that Many documents hold, number {n} of them é " for n in range(30)] + ["short", "", "x" * 39, "y" * 40, " " + "z" * 39, "Ä" * 40]
    rows = []
    for n in range(400):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"own line {n} {k} with enough characters to count" for k in range(rng.randint(0, 12))]
        lines = [rng.choice([line, line.upper() if line.isascii() else line, "\t" + line + " \r", line]) for line in lines]
        rows.append((n, "\n".join(lines)))
    hot = "The very common line that stands in every document here"
    rows = [(i, t + "\n" + hot + "\n" + hot if i % 3 == 0 else t) for i, t in rows]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1002, "\n\n"), (5, rows[5][1]), (5, rows[3][1]), (None, rows[3][1]), (1003, "\n".join([hot] * 3000))]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, place int, h1 long").repartition(3)
    for batches, fan, min_docs in ((4, 2, 5), (1, 2, 2), (5, 3, 7)):
        got = line_dedup.dedup_lines(frame, batches=batches, fan=fan, min_docs=min_docs).collect()
        assert collections.Counter(map(tuple, got)) == plain_lines(rows, 40, min_docs)
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_")]


def test_repeated_identifiers_as_in_sql(spark):
    line = "One line that stands in all of the documents here"
    rows = [(1, line), (1, line + "\na"), (1, line + "\nb"), (2, line), (3, line), (None, line), (None, line + "\nc")]
    for n in (0, 1):  # four documents, then five
        some = rows + [(4, line + "\nlast")] * n
        frame = spark.createDataFrame(some, "doc_id long, text string")
        got = line_dedup.dedup_lines(frame).collect()
        assert collections.Counter(map(tuple, got)) == plain_lines(some, 40, 5) and (sum(r.n_dropped for r in got) > 0) == bool(n)
        con = duckdb.connect()
        con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in some], pa.int64()), "text": [t for _, t in some]}))
        want = con.execute(SQL["op8_line_dedup"]).fetchall()
        assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == collections.Counter(want)


def test_runs_are_joined_without_shuffle_or_sort(spark):
    rows = lambda a, b: spark.range(a, b).select(F.substring(F.unhex(F.sha2(F.col("id").cast("string"), 256)), 1, 16).alias("h"), F.lit(1).cast("long").alias("docs"), F.col("id").alias("last")).repartition("h")
    with line_dedup.runs_of(spark, 3) as runs:
        runs.add(rows(0, 500))
        runs.add(rows(400, 900))
        batch = runs.bucketed(rows(0, 1000), "batch")
        fresh = runs.fresh(batch)
        for joined in (fresh, runs.totals()):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Sort " not in plan
            assert "SortMergeJoin" in plan and plan.count("Bucketed: true") >= 3
        assert sorted(r["last"] for r in fresh.collect()) == list(range(900, 1000))
        assert {r["last"]: r["docs"] for r in runs.totals().collect()} == {n: 2 if 400 <= n < 500 else 1 for n in range(900)}


def pages():
    rng = random.Random(6)
    html = [None, "", "<p>é</p>", "a\r\n\r\nb\nWARC/1.1\r\n\r\n", "http x 3 text/html 5\nfiledesc://", "x" * 70_000]
    html += [f"<html>{rng.randint(0, 40)}</html>" for _ in range(200)]
    rows = [(n, f"http://host/{n}?a b\n" if n % 3 else None, h) for n, h in enumerate(html)]
    return rows + [rows[2], rows[3], (None, "u", "<p>é</p>"), (None, None, "only here"), (None, None, "only here")]


@pytest.mark.parametrize(("at_least", "archive"), [(0, 5000), (14, 1 << 24)])
def test_round_trip_equals_brute_force(spark, at_least, archive):
    rows = pages()
    frame = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, head int").repartition(3)
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, h in payloads:
        if p is not None and len(h) >= at_least:
            first[h] = min(first.get(h, p), p)
    want, met = collections.Counter(), set()
    for p, h in sorted(payloads, key=lambda x: (x[0] is None, x[0] or 0)):
        d = base64.b32encode(hashlib.sha1(h).digest()).decode()
        again = len(h) >= at_least and h in met
        met.add(h)
        want[(p, len(h), d, "revisit" if again else "response", first.get(h) if again else None)] += 1
    got = warc.round_trip(frame, at_least=at_least, archive=archive).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_records_are_members_with_identifiers_of_their_own(spark, tmp_path):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    warc.write_arc(frame, f"{tmp_path}/arc", version=1, archive=4000)
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", archive=4000)
    ids, infos = [], 0
    for file in sorted(tmp_path.glob("warc/part-*")):
        data, members = file.read_bytes(), 0
        while data:
            one = zlib.decompressobj(wbits=31)
            content = one.decompress(data)
            data = one.unused_data
            if content:
                ((fields, _),) = warc.parse_warc(content)  # each member is a whole record
                ids.append(fields["warc-record-id"])
                infos += fields["warc-type"] == "warcinfo"
                assert (fields["warc-type"] == "warcinfo") == (members == 0)
            members += 1
        assert content == b""
    assert len(ids) == len(set(ids)) == len(pages()) + infos and infos > 3
    with_text = warc.read_warc(spark, f"{tmp_path}/warc", with_payload=True).filter("record_type = 'response'")
    assert {bytes(r.payload).decode() for r in with_text.collect()} == {h or "" for _, _, h in pages()}


@pytest.mark.parametrize("version", [1, 2])
def test_both_arc_versions(version):
    content = warc.arc_block(version) + warc.arc_record(version, 3, "http://a b", "é".encode(), "20200102030405") + warc.arc_record(version, None, None, b"", "2020")
    first, second = warc.parse_arc(content)
    assert (first.url, first.ip, first.date, first.mime) == ("http://a%20b", "127.0.0.1", "20200102030405", "text/html")
    assert warc.split_http(bytes(first.block))[1] == "é".encode() and second.url == "about:blank"
    assert warc._stamp("20200102030405") == "2020-01-02T03:04:05Z"
    for broken in (content[:-3], content.replace(b"text/html", b"text html"), content.replace(b"filedesc", b"file"), content.replace(f"{version} 0".encode(), b"3 0")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))


def test_warc_parser():
    one = warc.warc_record({"WARC-Type": "response", "X": None, "WARC-Record-ID": "<a>"}, b"a\r\n\r\nb")
    two = warc.warc_record({"WARC-Type": "metadata"}, b"")
    got = list(warc.parse_warc(one + two))
    assert got[0][1] == b"a\r\n\r\nb" and got[0][0]["warc-record-id"] == "<a>" and got[1][1] == b""
    for broken in (one[:-1], one[:-9], b"x" + one, one.replace(b"Length: 6", b"Length: 5")):
        with pytest.raises(ValueError):
            list(warc.parse_warc(broken))


def shuffled(spark):
    """Bytes that all stages so far have written for others to read."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))


def test_payloads_are_shuffled_as_compressed(spark, tmp_path):
    rng = random.Random(9)
    html = [base64.b32encode(rng.randbytes(12_500)).decode() for _ in range(150)]  # gzip takes a third off, LZ4 next to nothing
    html += html[:20]
    frame = spark.createDataFrame([(n, f"http://host/{n}", h) for n, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    warc.write_arc(frame, f"{tmp_path}/arc", version=2, archive=400_000)
    before = shuffled(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a large table of types
        warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", archive=400_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < shuffled(spark) - before < 0.8 * sum(map(len, html))
    got = warc.read_warc(spark, f"{tmp_path}/warc", with_payload=True).collect()
    assert {(r.page_id, r.payload and bytes(r.payload).decode()) for r in got} == {(n, h if n < 150 else None) for n, h in enumerate(html)}


@pytest.mark.parametrize("at_once", [1, 7])
def test_archives_and_types_meet_across_batches(spark, at_once):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(5)
    want = collections.Counter(map(tuple, warc.round_trip(frame, archive=1 << 24).collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        assert collections.Counter(map(tuple, warc.round_trip(frame, archive=3000).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
