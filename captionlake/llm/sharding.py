"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a key: 39 bits of a hash of the text, then 24 bits of a hash of the id and of
where the row lies (its file and its number there). Equal texts stand together, and a group of them
of any size can still be cut, even one that repeats a single row. Splitters between
shards are found by rounds that count, over all partitions, the exact bytes below candidate keys
and put new candidates between the nearest two of each splitter, until it is within tolerance.
Between shard splitters stand finer ones, so that the one exchange that follows deals small parts,
each sorted by itself; the counts below them number the rows of a shard without a gap.

The driver sees counts at candidate keys, a number set by parameters alone. Nulls count as empty
texts of no bytes, a null id is a value like any other. Repeated rows each have their place. A column
called shard, slot or size gives way to the new one; other columns stay, whatever they are called. An
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.llm.exact_dedup import located
from captionlake.llm.scratch import scratch, stored

TOP = 1 << 63
PART_BYTES = 128 << 20
PROBES = 15


def size_of(text: Column) -> Column:
    """Bytes of a row: those of its text and eight more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def sort_key(text: Column, place: Column) -> Column:
    """place: a hash of what tells rows of one text apart."""
    group = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 25)
    return F.shiftleft(group, 24).bitwiseOR(F.shiftrightunsigned(place, 40))


def count_below(sizes: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each of the ascending probes, and of all at the end."""

    def run(batches):
        total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            np.add.at(total, at, batch.column(1).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used]), pa.array(rows[used])], names=["at", "bytes", "rows"])

    summed = sizes.select("key", "size").mapInArrow(run, "at int, bytes long, rows long").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in summed.collect():
        total[r["at"]], rows[r["at"]] = r["bytes"], r["rows"]
    return np.cumsum(total), np.cumsum(rows)


@dataclass
class Splitters:
    keys: np.ndarray  # ascending; a part holds the keys from one to below the next
    parts: int  # of each shard
    base: np.ndarray  # rows of its shard before each part


def split(sizes: DataFrame, shards: int, *, tolerance: float = 0.001, part_bytes: int = PART_BYTES, parts: int | None = None) -> Splitters:
    """sizes: key (0 <= key < 2**63) and size. tolerance: of a shard's bytes, how far a splitter may be off."""
    whole = int(count_below(sizes, np.empty(0, np.int64))[0][-1])
    parts = parts or min(4096, max(8, -(-whole // (shards * part_bytes))))
    n = shards * parts
    target = np.array([whole * i // n for i in range(1, n)])
    allowed = np.where(np.arange(1, n) % parts == 0, tolerance * whole / shards, 0.1 * whole / n)
    low, high = np.zeros(n - 1, object), np.full(n - 1, TOP, object)
    low_bytes, high_bytes = np.zeros(n - 1, np.int64), np.full(n - 1, whole)
    while True:
        off = np.minimum(target - low_bytes, high_bytes - target)
        todo = np.flatnonzero((off > allowed) & (high - low > 1))
        if not len(todo):
            break
        gaps = {(int(low[i]), int(high[i])) for i in todo}
        each = max(PROBES, 4 * n // len(gaps))
        probes = sorted({a + (b - a) * k // (each + 1) for a, b in gaps for k in range(1, each + 1)} - {0})
        keys = np.array(probes, np.int64)
        below = count_below(sizes, keys)[0][:-1]
        after = np.searchsorted(below, target[todo], side="left")  # the first probe with at least so many bytes below
        for i, at in zip(todo, after, strict=True):
            if at < len(keys) and probes[at] < high[i]:
                high[i], high_bytes[i] = probes[at], below[at]
            if at and probes[at - 1] > low[i]:
                low[i], low_bytes[i] = probes[at - 1], below[at - 1]
    nearer = high_bytes - target < target - low_bytes
    keys = np.array([min(int(h) if up else int(a), TOP - 1) for a, h, up in zip(low, high, nearer, strict=True)], np.int64)
    rows = np.concatenate([[0], count_below(sizes, keys)[1][:-1]]) if len(keys) else np.zeros(1, np.int64)
    return Splitters(keys, parts, rows - np.repeat(rows[::parts], parts))


def shard(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, parts: int | None = None) -> DataFrame:
    """docs with shard, slot and size more: each row's shard, its place there from 0, and its bytes."""
    spark = docs.sparkSession
    docs, locator = located(docs)
    text, place = F.col(text_col), F.xxhash64(F.lit("shard"), F.col(id_col), locator)
    key = sort_key(text, place)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot", "size")]
    with scratch(spark):
        sizes = stored(docs.select(key.alias("key"), size_of(text).alias("size")), "shard-sizes")
        found = split(sizes, shards, tolerance=tolerance, parts=parts)
    keys, per_shard = found.keys, found.parts

    @F.pandas_udf("int")
    def part(key):
        import pandas as pd

        return pd.Series(np.searchsorted(keys, key.to_numpy(), side="right").astype(np.int32))

    # A row for each part, at most 4096 for each shard: bounded.
    base = spark.createDataFrame([(n, int(b)) for n, b in enumerate(found.base)], "part int, base long")
    rows = docs.select(F.struct(*kept).alias("row"), size_of(text).alias("size"), key.alias("key"), place.alias("tie"), F.col(id_col).alias("id")).withColumn("part", part("key"))
    number = F.row_number().over(Window.partitionBy("part").orderBy("key", "tie", "id"))
    placed = rows.withColumn("place", number).join(F.broadcast(base), "part")
    return placed.select("row.*", F.floor(F.col("part") / per_shard).cast("int").alias("shard"), (F.col("base") + F.col("place") - 1).alias("slot"), "size")
