"""Exact length histogram of encoded documents, and what its suffix sums answer.

Documents are encoded where they are read and counted by length before any shuffle. ``suffix_sums``
adds, for each length, the documents and ids of at least that length, so that the total under any
context limit is one look-up: ids at all lengths up to the limit, and the limit for each longer
document. The sums go by blocks of lengths: within a block by a window of its own, over the blocks
by their totals, so no task holds all lengths.

Context limits that are no document's length are answered by rows of their own, of no documents.

A null or empty text has length 0. Repeated rows count each. An empty table gives no rows but those of
the limits asked for, with totals of zero. Other columns play no part, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captionlake.llm import bpe as bpe_
from captionlake.llm.scratch import stored

BLOCK = 4096
#: Context limits that the registered query answers beside all lengths that occur.
LIMITS = tuple(1 << n for n in range(7, 21))


def lengths(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """A row for each length in each task: n_tokens, docs."""

    def run(batches):
        bpe = bpe_.load(path)
        counted: dict[int, int] = {}
        for batch in batches:
            for _, counts in bpe.encode(bpe_.in_texts(batch.column(0))):
                for n, k in zip(*(x.tolist() for x in np.unique(counts, return_counts=True)), strict=True):
                    counted[n] = counted.get(n, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(counted.keys(), pa.int64()), pa.array(counted.values(), pa.int64())], names=["n_tokens", "docs"])

    return docs.select(text_col).mapInArrow(run, "n_tokens long, docs long")


def histogram(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """n_tokens, docs: how many documents have each length that occurs."""
    return lengths(docs, path, text_col=text_col).groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(hist: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """n_tokens, docs, docs_at_least, tokens_at_least, all_docs, all_tokens."""
    hist = stored(hist.withColumn("block", F.floor(F.col("n_tokens") / block)), "lengths")
    totals = hist.groupBy("block").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens"))
    # One row for each block of lengths that occurs: a few even where the longest document has millions of ids.
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    after = totals.select("block", F.coalesce(F.sum("docs").over(down), zero).alias("docs_after"), F.coalesce(F.sum("tokens").over(down), zero).alias("tokens_after"), F.sum("docs").over(Window.partitionBy()).alias("all_docs"), F.sum("tokens").over(Window.partitionBy()).alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = hist.join(after, "block")
    return summed.select(
        "n_tokens", "docs",
        (F.col("docs_after") + F.sum("docs").over(within)).alias("docs_at_least"),
        (F.col("tokens_after") + F.sum(F.col("docs") * F.col("n_tokens")).over(within)).alias("tokens_at_least"),
        "all_docs", "all_tokens",
    )


def with_limits(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """hist with a row for each of limits (one column, limit: non-negative numbers) that isn't there, of no documents."""
    asked = limits.select(F.col("limit").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("docs"))
    return hist.select("n_tokens", "docs").union(asked).groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def answers(sums: DataFrame) -> DataFrame:
    """sums and, with each length as the context limit: tokens_truncated (ids left when every document is cut there) and share_at_most (of documents no longer; null if there are none)."""
    beyond = F.col("docs_at_least") - F.col("docs")
    tokens_beyond = F.col("tokens_at_least") - F.col("docs") * F.col("n_tokens")
    cut = F.col("all_tokens") - tokens_beyond + beyond * F.col("n_tokens")
    share = (F.col("all_docs") - beyond) / F.nullif(F.col("all_docs"), F.lit(0))
    return sums.select("*", cut.alias("tokens_truncated"), share.alias("share_at_most"))


def truncated(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """limits: one column, limit, any non-negative numbers. limit, tokens_truncated, docs_truncated; zero for an empty corpus."""
    asked = limits.select(F.col("limit").cast("long").alias("limit")).distinct()
    every = answers(suffix_sums(with_limits(sums, asked)))
    beyond = F.col("docs_at_least") - F.col("docs")
    return every.join(asked, F.col("n_tokens") == F.col("limit")).select("limit", "tokens_truncated", beyond.alias("docs_truncated"))


def quantile(sums: DataFrame, share: float | Column) -> DataFrame:
    """One row, n_tokens: the least length that at least the given share of documents don't exceed (null if there are none)."""
    at_most = F.col("all_docs") - F.col("docs_at_least") + F.col("docs")
    return sums.filter(at_most >= F.lit(share) * F.col("all_docs")).agg(F.min("n_tokens").alias("n_tokens"))
