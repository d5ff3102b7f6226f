"""What one discovery may take, for roots of any size: no root's files or tokens meet in one task.

Rows are put in order by ranges of it, so a large root lies in several blocks; what a block needs to
know of those before it are totals, a row for each root and block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionlake.shared import checkpointed

# What one discovery may take in all.
MAX_FILES, MAX_BYTES, MAX_TERMS, MAX_EVIDENCE = 512, 16_000_000, 20_000, 50_000


def within_budget(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files: root (if there are several), path, length. For each root its files in order of path, each path once, until max_files are taken; one that would pass max_bytes is left out, smaller ones after it are not.

    Whether a file is taken hangs on all before it, but one with max_files before it that are no
    larger can't be: had there been room for it, there was for each of those. A first pass over the
    blocks leaves such files out. Of n files in no order of size it keeps about max_files times
    the logarithm of n; of files that shrink from name to name it keeps all. A second pass reads
    what is left of a root in order, and holds its two sums.
    """
    if "root" not in files.columns:
        return within_budget(files.withColumn("root", F.lit("")), max_files, max_bytes).drop("root")
    # Names and sizes alone; what is not small enough for the whole budget goes before.
    sizes = files.filter(F.col("length") <= max_bytes).groupBy("root", "path").agg(F.min("length").cast("long").alias("length"))
    blocks = sizes.repartitionByRange("root", "path").sortWithinPartitions("root", "path")
    left = blocks.mapInArrow(_contenders(max_files), sizes.schema)
    taken = left.repartition("root").sortWithinPartitions("root", "path").mapInArrow(_taken(max_files, max_bytes), sizes.schema)
    other = taken.select(F.col("root").alias("_root"), F.col("path").alias("_path"))
    return files.dropDuplicates(["root", "path"]).join(other, F.col("root").eqNullSafe(F.col("_root")) & F.col("path").eqNullSafe(F.col("_path")), "left_semi")


def _contenders(max_files: int):
    """Of sorted rows those with fewer than max_files of their root before them that are no larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, least = None, []
        for batch in batches:
            kept = []
            for at, (r, n) in enumerate(zip(batch.column("root").to_pylist(), batch.column("length").to_pylist(), strict=True)):
                if r != root:
                    root, least = r, []
                if len(least) < max_files:
                    heapq.heappush(least, -n)
                elif least and n < -least[0]:
                    heapq.heapreplace(least, -n)
                else:
                    continue
                kept.append(at)
            yield batch.take(pa.array(kept, pa.int32()))

    return run


def _taken(max_files: int, max_bytes: int):
    """Of sorted rows those that fit, with what was taken of their root before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, n, room = None, 0, max_bytes
        for batch in batches:
            kept = []
            for at, (r, size) in enumerate(zip(batch.column("root").to_pylist(), batch.column("length").to_pylist(), strict=True)):
                if r != root:
                    root, n, room = r, 0, max_bytes
                if n < max_files and size <= room:
                    n, room = n + 1, room - size
                    kept.append(at)
            yield batch.take(pa.array(kept, pa.int32()))

    return run


def within_terms(tokens: DataFrame, max_terms: int = MAX_TERMS, max_evidence: int = MAX_EVIDENCE) -> DataFrame:
    """tokens: root, rank (of the kind of source), path, line, place, key. For each root those in order until it has so many terms or tokens.

    A file is read on when the terms are all there, until it has one more; no further file is begun.
    """
    if max_terms <= 0 or max_evidence <= 0:
        return tokens.filter(F.lit(False))
    order = ["root", "rank", "path", "line", "place"]
    block = ["root", "_block"]
    # Rows of a root follow one another in a block, so _at counts them; written, so that it stays as it is.
    placed = checkpointed(tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_at")))
    earlier = Window.partitionBy("root").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def totals(rows: DataFrame, *more) -> DataFrame:
        """root, _block, _n (its rows there), _before (its rows in blocks before): no more rows than roots and blocks."""
        return rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), *more).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))

    # Where each term comes first, and which of these are the last that may be there and the one after it.
    met = placed.groupBy("root", "key").agg(F.min(F.struct("_at", "_block", "rank", "path")).alias("x")).select("root", "x.*")
    near = totals(met).filter((F.col("_before") <= max_terms) & (F.col("_before") + F.col("_n") >= max_terms)).drop("_n")
    nth = F.row_number().over(Window.partitionBy(*block).orderBy("_at")) + F.col("_before")
    ranked = _joined(met, near, block, "inner").withColumn("_nth", nth)
    ends = ranked.groupBy("root").agg(F.max(F.when(F.col("_nth") == max_terms, F.struct("rank", "path"))).alias("_last"), F.max(F.when(F.col("_nth") == max_terms + 1, F.col("_at"))).alias("_end"))
    limits = _joined(totals(placed, F.min("_at").alias("_start")), ends, ["root"], "left")
    read = (F.col("_at") - F.col("_start") + F.col("_before") < max_evidence) & (F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    begun = F.col("_last").isNull() | (F.struct("rank", "path") <= F.col("_last"))
    return _joined(placed, limits, block, "inner").filter(read & begun).select(*tokens.columns)


def _joined(rows: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows with what other has for the same key, where null is a key like any other."""
    named = other.withColumnsRenamed({c: f"_other{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_other{c}")) for c in on]
    return rows.join(named, same, how).drop(*(f"_other{c}" for c in on))
