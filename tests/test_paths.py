"""Paths against the library's own."""

import os
import random

from pyspark.sql import functions as F

from captionlake.functions import paths as P


def test_against_os_path(spark):
    rng = random.Random(12)

    def path():
        return rng.choice(["/", "/", "//", "", "./"]) + rng.choice(["/", "//"]).join(rng.choice(["a", "b", "c", "..", ".", "é x"]) for _ in range(rng.randrange(7))) + rng.choice(["", "/"])

    rows = [(n, path(), path()) for n in range(3000)] + [(3000, "/", "/"), (3001, "", ""), (3002, "/a", "/a"), (3003, "/a/b", "/a/c"), (3004, "/..", "/a")]
    whole = lambda p: "/" + os.path.normpath("/" + (p if p.startswith("/") else f"/w/x/{p}")).lstrip("/")
    table = spark.createDataFrame(rows, "n int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = table.select("n", P.plain(a, "/w/x").alias("plain"), P.tracked_reference(a, b, "/w/x").alias("tracked"), P.manifest_reference(a, b, "/w/x").alias("manifest"))
    told = {r.n: r for r in got.collect()}
    for n, left, right in rows:
        here, there = whole(left), whole(right)
        assert told[n].plain == here
        seen = os.path.relpath(there, here)
        assert told[n].tracked == ("" if seen == "." else seen)
        parent = os.path.dirname(there)
        if os.path.commonpath([here, there]) == here:
            want = "" if seen == "." else seen
        elif there != "/" and os.path.commonpath([here, parent]) == parent:
            want = os.path.join(os.path.relpath(parent, here), os.path.basename(there))
        else:
            want = there
        assert told[n].manifest == want


def test_nulls(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(P.plain(none), P.tracked_reference(none, F.lit("/a")), P.manifest_reference(F.lit("/a"), none)).first()
    assert tuple(row) == (None, None, None)
