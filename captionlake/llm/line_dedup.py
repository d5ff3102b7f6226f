"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A text is split at line feeds. A line's key is the line stripped of ASCII white space, A-Z in lower
case; keys of fewer than ``min_chars`` code points play no part. Documents come in batches. A batch
merge-anti-joins its key hashes with those of every run, one after another; new ones are its own run
at level 0, and for known ones a note says how many more documents hold them. When ``fan`` runs share
a level they are merged to one run of the next. Runs share no key, so a key stands once in all of
them, with the number of documents and the greatest identifier of its first batch; the notes add the
rest.

Runs, notes and batches are tables bucketed and sorted by hash, a file for each bucket, so these joins
and merges neither shuffle nor sort the runs again: a batch alone is shuffled, once.

A key in ``min_docs`` documents or more loses all its lines but those of the greatest identifier
that holds it. Other lines stay, joined by line feeds. Hashes are the first 128 bits of SHA-256.

A null or empty text is one empty line. Rows that agree in identifier, texts alike or not, count as
one document, and so do all rows without one, which is below all others. Each row has its own result.
An empty table gives no rows. Other columns play no part, whatever they are called.

Skew: keys are counted before they are shuffled; what is joined by key has a few numbers a row, and
a hot key's rows are split by Spark's adaptive skew join.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm.exact_dedup import normal
from captionlake.llm.scratch import new_path, scratch, stored

SPACE = " \t\n\x0b\x0c\r"
#: Spark reads a sorted bucket of one file as sorted only if asked to.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return normal(F.btrim(line, F.lit(SPACE)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("of"), text.alias("text"))


def keyed_lines(rows: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """For each line with a key: id, of (a hash of the text), place, h (of the key), batch (of the document)."""
    lines = rows.select("id", "of", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keys = lines.select("id", "of", "place", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    hash_ = F.substring(F.unhex(F.sha2("key", 256)), 1, 16)
    return keys.select("id", "of", "place", hash_.alias("h"), F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"))


class Runs:
    """Key runs by level, sorted and without a common key, and notes, by level too, on keys met again."""

    def __init__(self, spark: SparkSession, fan: int):
        self.spark, self.fan = spark, fan
        conf = spark.conf
        self.buckets = int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[list[DataFrame]] = []
        self.notes: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def bucketed(self, rows: DataFrame, name: str) -> DataFrame:
        """rows, dealt by h, written with a sorted file for each bucket."""
        self.tables.append(f"line_{name}_{uuid.uuid4().hex}")
        rows.write.option("path", new_path(self.spark, f"line-{name}")).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a bucketed batch whose keys no run has: a merge join with each run."""
        return reduce(lambda rows, run: rows.join(run.select("h").hint("merge"), "h", "left_anti"), _every(self.runs), batch)

    def add(self, batch: DataFrame) -> None:
        """batch: h, docs, last; each key once."""
        batch = self.bucketed(batch, "batch")
        fresh = batch
        if self.runs:
            fresh = self.bucketed(self.fresh(batch), "fresh")
            self._put(self.notes, 0, self.bucketed(batch.join(fresh.select("h").hint("merge"), "h", "left_anti"), "notes"))
        self._put(self.runs, 0, fresh)

    def _put(self, levels: list[list[DataFrame]], level: int, run: DataFrame) -> None:
        if level == len(levels):
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) == self.fan:
            merged = reduce(lambda a, b: self.bucketed(_merged(a, b, "full"), "run"), levels[level])
            levels[level] = []
            self._put(levels, level + 1, merged)

    def totals(self) -> DataFrame:
        """h, docs, last of every key: each run with what the notes add to it."""
        return reduce(DataFrame.union, (reduce(lambda a, b: _merged(a, b, "left"), _every(self.notes), run) for run in _every(self.runs)))

    def drop(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _every(levels: list[list[DataFrame]]) -> list[DataFrame]:
    return [run for level in levels for run in level]


def _merged(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Two tables of h, docs, last by a merge join of their sorted buckets: the counts of a key added up."""
    b = b.select("h", F.col("docs").alias("more_docs"), F.col("last").alias("more_last"))
    added = F.coalesce("docs", F.lit(0)) + F.coalesce("more_docs", F.lit(0))
    return a.join(b.hint("merge"), "h", how).select("h", added.alias("docs"), F.greatest("last", "more_last").alias("last"))


@contextlib.contextmanager
def runs_of(spark: SparkSession, fan: int) -> Iterator[Runs]:
    """Runs whose tables are dropped at the end."""
    before = spark.conf.get(ORDERED, None)
    spark.conf.set(ORDERED, "true")
    runs = Runs(spark, fan)
    try:
        with scratch(spark):
            yield runs
    finally:
        runs.drop()
        spark.conf.unset(ORDERED) if before is None else spark.conf.set(ORDERED, before)


def dedup_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fan: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: id_col, n_lines (before), n_dropped, kept (the text that stays)."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    lines = stored(keyed_lines(rows, min_chars, batches), "line-keys", by="batch")
    totals_path = new_path(spark, "line-totals")
    with runs_of(spark, fan) as runs:
        for n in range(batches):
            # A document counts once for each key.
            held = lines.filter(F.col("batch") == n).select("h", "id").distinct()
            runs.add(held.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last")))
        # Written first, so that nothing is grouped on the way to the join and Spark can split a hot key's rows.
        runs.totals().filter(F.col("docs") >= min_docs).select("h", "last").write.parquet(totals_path)
    totals = spark.read.schema(f"h binary, last {docs.schema[id_col].dataType.simpleString()}").parquet(totals_path)
    hit = lines.drop("batch").join(totals, "h").filter(~F.col("id").eqNullSafe(F.col("last")))
    drops = hit.groupBy(F.col("id").alias("drop_id"), F.col("of").alias("drop_of")).agg(F.collect_set("place").alias("places"))
    drops = stored(drops, "line-drops").hint("shuffle_hash")
    met = rows.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("of") == F.col("drop_of")), "left")

    def without(split: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "places")
        return F.array_join(F.transform(left, lambda n: F.get(split, n)), "\n")

    # The split text is bound once, as the variable of a lambda.
    kept = F.transform(F.array(F.split("text", "\n")), without)[0]
    return met.select(
        F.col("id").alias(id_col),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )
