"""BLAKE3 against its published vectors, files in parts over several tasks, and receipts whose digests are such."""

import json
import random

import numpy as np

from captionlake.functions import blake3
from captionlake.operators import attest as A
from captionlake.operators import workflow as W

# Of the published test vectors, whose input is 0 to 250 again and again.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def data(n):
    return np.resize(np.arange(251, dtype=np.uint8), n) if n else np.empty(0, np.uint8)


def test_published_vectors(spark):
    files = spark.createDataFrame([(n, bytearray(data(n).tobytes()), "x") for n in VECTORS], "path long, content binary, digest string").repartition(3)
    assert {r.path: r.digest for r in A.blake3_digests(files).collect()} == VECTORS


def test_any_mix_equals_each_alone():
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 63, 64, 65, 1023, 1024, 1025, 3000, 5 * 1024, 7 * 1024 + 1, 20_000]) for _ in range(60)]
    flat = np.concatenate([data(n) for n in sizes])
    ends = np.append(0, np.cumsum(sizes))
    assert blake3.digests(flat, ends) == [blake3.digests(data(n), np.array([0, n]))[0] for n in sizes]


def test_files_in_parts(spark, monkeypatch):
    sizes = {"a": 0, "b": 5000, "c": 16 * 1024, "d": 16 * 1024 + 1, "e": 100_000, "f": 102_400}
    files = spark.createDataFrame([(p, bytearray(data(n).tobytes())) for p, n in sizes.items()], "path string, content binary")
    monkeypatch.setattr(blake3, "PART", 16 * 1024)
    parts = A.in_parts(files).repartition(5)
    assert parts.filter("path = 'f'").count() == 7
    got = {r.path: r.digest for r in A.part_digests(parts).collect()}
    assert got == {r.path: r.digest for r in A.blake3_digests(files).collect()} and got["f"] == VECTORS[102_400]


def test_verify_takes_either_algorithm(spark):
    text = "spoken"
    files = spark.createDataFrame([("transcript.json", text), ("transcript.txt", text + "!"), ("../t.mp4", "m")], "path string, content string")
    both = A.blake3_digests(files).unionByName(A.file_digests(files)).withColumn("receipt_id", A.F.lit(1)).withColumn("is_file", A.F.lit(True))
    digests = {(r.path, r.algorithm): r.digest for r in both.collect()}
    file = lambda path, how: {"path": path, "digest": {"algorithm": how, "value": digests[path, how]}}
    receipt = {
        "schema_version": 3, "tool_version": "1", "mode": "transcript-only", "source": file("../t.mp4", "blake3"), "artifacts": [file("transcript.json", "blake3"), file("transcript.txt", "sha256")],
        "stages": [{"stage": s, "status": "executed"} for s in A.STAGES["transcript-only"]], "providers": [{"stage": s, "provider": "x"} for s in A.PROVIDED],
    }
    raw = spark.createDataFrame([(1, json.dumps(receipt), True)], "receipt_id int, json string, is_file boolean")
    assert W.verify(raw, both).count() == 0
    other = both.withColumn("digest", A.F.when((A.F.col("path") == "transcript.json") & (A.F.col("algorithm") == "blake3"), "0" * 64).otherwise(A.F.col("digest")))
    assert [(r.path, r.problem) for r in W.verify(raw, other).collect()] == [("transcript.json", "changed")]
