"""Web archives: writing legacy ARC files, converting them to WARC, and reading WARC files back.

An ARC file opens with a version block that names the fields of the header lines: version 1 has
five, version 2 ten. Each record is a header line, as many bytes as its last field declares, and a
line feed. The converter follows the declared lengths and makes for each record the WARC fields it
lacks: an identifier from the place of the record in its file, a W3C timestamp from the 14 digits,
a type, and digests of payload and block (SHA-1, base32).

Of records with equal payloads (by length, SHA-1 and SHA-256) of at least ``at_least`` bytes, the one with
the least page identifier is a response; the others are revisits that refer to it and hold the
HTTP header alone. Shorter payloads are all responses.

Files are written by Spark's text writer, a whole archive of about ``ARCHIVE`` bytes to a row and a
row to a file, and read by Spark's binary file source; the driver sees none of them. ARC files are
compressed whole; in a WARC file each record is a gzip member of its own, so it can be read alone from
its offset, and an empty member ends the file. A page larger than that is an archive of its own, up to
the 2 GB of a Spark row.

A null html is an empty payload, a null url is written as about:blank. A null page identifier is
above all others and is left out of the header. Repeated rows each have a record. An empty table
gives no archive and no rows. White space and control characters in a url are percent-encoded. Other
columns play no part, whatever they are called.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm.scratch import delete, new_path, stored

ARCHIVE = 16 << 20
# Fixed values of the two formats.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    """SHA-1 as 32 upper-case base32 digits."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


#: A gzip member of nothing: what Spark's text writer puts after a row, in the place of a line feed.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def _in_archives(records: Iterator[bytes], opening, size: int, packed=bytes) -> Iterator[pa.RecordBatch]:
    """Records, each packed, joined to archives of about size bytes (unpacked), one a batch; opening(n) gives what archive n begins with."""
    held, n, total = [], 0, 0

    def archive():
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    for record in records:
        if held and total + len(record) > size:
            yield archive()
            held, n, total = [], n + 1, 0
        if not held:
            held.append(packed(opening(n)))
        held.append(packed(record))
        total += len(record)
    if held:
        yield archive()


def _member(record: bytes) -> bytes:
    return gzip.compress(record, 6, mtime=0)


def _write(archives: DataFrame, path: str, end: bytes, compression: str) -> None:
    """archives: a binary column of archives, each without the bytes that all of them end with."""
    # The text writer writes the bytes of a string as they are, and after them its line separator in the encoding given.
    rows = archives.select(F.col("archive").cast("string").alias("archive"))
    rows.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).option("compression", compression).text(path)


PIECE = 8192  # bytes of a compressed archive that are looked at beyond a member's end, at most


def _members(content: pa.BinaryScalar, name: str) -> Iterator[bytes]:
    """The parts of an archive: its gzip members one by one, or all of it where it isn't compressed."""
    data = memoryview(content.as_buffer()).cast("B")
    if data[:2] != b"\x1f\x8b":
        yield data.tobytes()
        return
    at = 0
    while at < len(data):
        one, parts = zlib.decompressobj(wbits=31), []
        while not one.eof and at < len(data):
            parts.append(one.decompress(data[at : at + PIECE]))
            at = min(len(data), at + PIECE)
        if not one.eof:
            raise ValueError(f"{name}: the archive is cut short")
        at -= len(one.unused_data)
        yield b"".join(parts)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the archives in a folder, which may have none."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException:
        return spark.createDataFrame([], "path string, content binary")


# -- ARC ---------------------------------------------------------------------------------------


def arc_block(version: int) -> bytes:
    body = f"{version} 0 captionlake\n{FIELDS[version]}\n".encode()
    tail = "" if version == 1 else " 200 - - 0 archive.arc"
    return f"filedesc://archive.arc 0.0.0.0 20260101000000 text/plain{tail} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes, date: str) -> bytes:
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    tail = "" if version == 1 else f" 200 {digest(payload)} - 0 archive.arc"
    return f"{url} 127.0.0.1 {date} text/html{tail} {len(block)}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, path: str, *, version: int = 1, date: str = "20260101000000", archive: int = ARCHIVE) -> None:
    """pages: page_id, url, html. ARC files at path."""

    def run(batches):
        def records():
            for batch in batches:
                for at in range(batch.num_rows):
                    page_id, url, html = (c[at].as_py() for c in batch.columns)
                    yield arc_record(version, page_id, url, html or b"", date)

        for batch in _in_archives(records(), lambda n: arc_block(version), archive):
            whole = batch.column(0)[0].as_buffer().to_pybytes().removesuffix(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["archive"])

    _write(pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, "archive binary"), path, b"\n", "gzip")


@dataclass
class ArcRecord:
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    block: memoryview


def parse_arc(content: bytes, name: str = "") -> Iterator[ArcRecord]:
    """The records of an ARC file but for its version blocks. A header line or length that doesn't fit is an error."""
    view, at, fields = memoryview(content), 0, 0
    while at < len(content):
        if content[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = content.find(b"\n", at)
        parts = content[at : end if end >= 0 else len(content)].decode("utf-8").split(" ")
        first = parts[0].startswith("filedesc://")
        if end < 0 or not parts[-1].isdigit() or not (first or len(parts) == fields):
            raise ValueError(f"{name}: no header line of an ARC record at byte {at}")
        length = int(parts[-1])
        block = view[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"{name}: the record at byte {at} is cut short")
        if first:
            version = bytes(block).split(b" ", 1)[0].decode()
            if version not in ("1", "2"):
                raise ValueError(f"{name}: unknown version {version} of ARC")
            fields = len(FIELDS[int(version)].split())
        else:
            yield ArcRecord(at, parts[0], parts[1], parts[2], parts[3], block)
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The header of an HTTP response, with its empty line, and the payload. Without a header, all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode().strip() if found else None


def _stamp(date: str) -> str:
    date = date[:14].ljust(14, "0")
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _whole(text: str | None) -> int | None:
    return int(text) if text is not None else None


def _record_id(name: str, offset: int) -> str:
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{offset}")
    return f"<urn:uuid:{own}>"


ROW = "file string, offset long, record_id string, uri string, ip string, stamp string, page_id long, head binary, payload binary, payload_digest string, payload_sha256 binary, payload_bytes long"


def read_arc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """A row for each record of the ARC files at path, with its place and the fields that WARC asks for; payload is null where it isn't asked for."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for r in parse_arc(b"".join(_members(content, name)), name):
                    head, payload = split_http(bytes(r.block))
                    page_id = _whole(http_field(head, "X-Page-Id"))
                    digests = digest(payload), hashlib.sha256(payload).digest()
                    rows.append((name, r.offset, _record_id(name, r.offset), r.url, r.ip, _stamp(r.date), page_id, head, payload if with_payload else None, *digests, len(payload)))
                    size += len(r.block)
                    if size > ARCHIVE // 2:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return _files(spark, path).mapInArrow(run, ROW)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str = ROW) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])


# -- WARC --------------------------------------------------------------------------------------


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _opening(name: str) -> bytes:
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {name}")
    return warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{own}>", "WARC-Date": "2026-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"software: captionlake\r\nformat: WARC File Format 1.1\r\n")


def convert(spark: SparkSession, arc_path: str, warc_path: str, *, at_least: int = 0, archive: int = ARCHIVE) -> None:
    """The records of the ARC files at arc_path as WARC files at warc_path, equal payloads as revisits."""
    # First the facts alone decide on types; the archives are then shuffled once, compressed as they are, each to where the types of its records go.
    same = ["payload_digest", "payload_sha256", "payload_bytes"]
    facts = stored(read_arc(spark, arc_path, with_payload=False).select("file", "offset", "record_id", "uri", "stamp", "page_id", *same), "warc-facts")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "uri", "stamp")
    first = facts.filter(F.col("payload_bytes") >= at_least).groupBy(*same).agg(F.min(order).alias("first"))
    first = first.select(*same, F.col("first.record_id").alias("to_id"), F.col("first.uri").alias("to_uri"), F.col("first.stamp").alias("to_stamp"))
    # Written first, so that nothing is grouped on the way to the join and Spark can split a hot payload's rows.
    types = facts.select("file", "offset", "record_id", *same).join(stored(first, "warc-first"), same, "left")
    types = types.select("file", "offset", "payload_digest", *(F.when(F.col("to_id") != F.col("record_id"), F.col(c)).alias(c) for c in ("to_id", "to_uri", "to_stamp")))
    # An archive comes before the types of its records, which come in its order.
    archives = _files(spark, arc_path).select(F.col("path").alias("file"), F.lit(-1).cast("long").alias("offset"), "content")
    names = ["file", "offset", "content", "payload_digest", "to_id", "to_uri", "to_stamp"]
    # About a task for an archive, as hashes of few names fall together; fewer where archives are small.
    tasks = (facts.agg(F.sum("payload_bytes")).first()[0] or 0) // (ARCHIVE // 2) + 1
    rows = archives.unionByName(types, allowMissingColumns=True).select(names).repartition(tasks, "file").sortWithinPartitions("file", "offset")

    def run(batches):
        def records():
            told = ({n: c[at] for n, c in zip(names, batch.columns, strict=True)} for batch in batches for at in range(batch.num_rows))
            for first in told:
                name = first["file"].as_py()
                if not first["content"].is_valid:
                    raise ValueError(f"{name}: there is no record at byte {first['offset']}")
                for record in parse_arc(b"".join(_members(first["content"], name)), name):
                    r = {n: v.as_py() for n, v in next(told, {}).items() if n != "content"}
                    if (r.get("file"), r.get("offset")) != (name, record.offset):
                        raise ValueError(f"{name}: the record at byte {record.offset} has no type")
                    again = r["to_id"] is not None
                    block = bytes(record.block)
                    if again:
                        block, _ = split_http(block)
                    fields = {
                        "WARC-Type": "revisit" if again else "response", "WARC-Record-ID": _record_id(name, record.offset), "WARC-Date": _stamp(record.date), "WARC-Target-URI": record.url, "WARC-IP-Address": record.ip,
                        "WARC-Profile": PROFILE if again else None, "WARC-Refers-To": r["to_id"], "WARC-Refers-To-Target-URI": r["to_uri"], "WARC-Refers-To-Date": r["to_stamp"],
                        "WARC-Payload-Digest": f"sha1:{r['payload_digest']}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response",
                    }
                    yield warc_record(fields, block)

        part = TaskContext.get().partitionId()
        yield from _in_archives(records(), lambda n: _opening(f"{warc_path} {part} {n}"), archive, _member)

    _write(rows.mapInArrow(run, "archive binary"), warc_path, EMPTY_MEMBER, "none")


def parse_warc(content: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields, by lower-case name, and the block of each record."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at : max(end, at)].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError(f"{name}: no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = content[end + 4 : end + 4 + length]
        if len(block) != length or content[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at byte {at} doesn't end where its length says")
        yield fields, block
        at = end + 8 + length


READ = "record_id string, record_type string, uri string, page_id long, payload_bytes long, payload_digest string, to_id string, payload binary"


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """A row for each response and revisit of the WARC files at path. A payload that doesn't fit its digest is an error.

    payload_bytes of a revisit are those that its HTTP header declares.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for fields, block in (record for member in _members(content, name) for record in parse_warc(member, name)):
                    if (kind := fields["warc-type"]) not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    told = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != told:
                        raise ValueError(f"{name}: the payload of {fields['warc-record-id']} doesn't fit its digest")
                    n = len(payload) if kind == "response" else _whole(http_field(head, "Content-Length"))
                    rows.append((fields["warc-record-id"], kind, fields["warc-target-uri"], _whole(http_field(head, "X-Page-Id")), n, told, fields.get("warc-refers-to"), payload if with_payload and kind == "response" else None))
                    size += len(block) if with_payload else 0
                    if size > ARCHIVE // 2 or len(rows) >= 10_000:
                        yield _batch(rows, READ)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, READ)

    return _files(spark, path).mapInArrow(run, READ)


def round_trip(pages: DataFrame, *, at_least: int = 0, archive: int = ARCHIVE) -> DataFrame:
    """pages written to ARC (version 2), converted to WARC and read back.

    A row for each page: page_id, payload_bytes, payload_digest, record_type, refers_to (the
    response's page_id, for revisits).
    """
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    write_arc(pages, f"{folder}/arc", version=2, archive=archive)
    convert(spark, f"{folder}/arc", f"{folder}/warc", at_least=at_least, archive=archive)
    delete(spark, f"{folder}/arc")
    read = stored(read_warc(spark, f"{folder}/warc").drop("payload", "uri"), "warc-read")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = read.filter("record_type = 'response'")
    named = responses.select(F.col("record_id").alias("to_id"), F.col("page_id").alias("refers_to"))
    revisits = read.filter("record_type = 'revisit'").join(named, "to_id")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).union(revisits.select(columns))
