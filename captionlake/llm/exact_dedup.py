"""Exact deduplication as a stateful stream, in DataFrame operations only.

``digest_state`` is the stream: a keyed aggregation whose state lies on disk (RocksDB, changes
and snapshots in the stream's checkpoint folder) and never expires. For each digest it retains
the greatest (identifier, content locator) and the number of rows. A later stream over the same
folder goes on from that state. ``resolve`` then checks full texts: every row whose digest has
been met more than once is compared, byte for byte, with the text at the retained locator.

Texts are equal when identical after lower-casing A-Z only; a null counts as empty. The row with
the greatest identifier stays; among rows that repeat an identifier, the one with the greatest
locator. A null identifier is below all others. An empty table gives no rows. Other columns of
the input play no part, whatever they are called.

Skew: the state is pre-aggregated before its shuffle. In the comparison a group of n rows is
dealt to n / SPREAD keys, each with one copy of the retained text.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm.scratch import new_path, stored

SPREAD = 256
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else each store, however small, holds megabytes of disk in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """text with A-Z lower-cased, empty for null. lower() does just that where all is ASCII, faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs and a column that says where each row lies: file and row. Rows of no file are written to one."""
    # Not by name, as a column may be called so too.
    try:
        docs.select(_place(docs.metadataColumn("_metadata"))).schema  # noqa: B018  raises for rows of no file
    except AnalysisException:
        docs = stored(docs, "dedup-input")
    return docs, _place(docs.metadataColumn("_metadata"))


def _place(where: Column) -> Column:
    return F.concat_ws("#", where["file_path"], F.lpad(where["row_index"].cast("string"), 12, "0"))


def digest_state(digests: DataFrame, folder: str) -> DataFrame:
    """digests: a stream of id, digest, locator. Its state so far: digest, keep_id, keep_locator, group_size.

    Runs until what is there has been read. folder holds the checkpoint and the changes of each
    batch, which a batch that is run again after a failure overwrites.
    """
    spark = digests.sparkSession
    state = digests.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("top"), F.count(F.lit(1)).alias("group_size"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in ROCKS}
    try:
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    finally:  # the stream has its own copy of the settings from its start on
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    try:
        changes = spark.read.parquet(f"{folder}/changes")
    except AnalysisException:  # no batch: there was nothing to read
        changes = spark.createDataFrame([], state.schema)
    # Counts only grow, and so do the greatest rows: the last change of a digest has the maximum of both.
    last = changes.groupBy("digest").agg(F.max("top").alias("top"), F.max("group_size").alias("group_size"))
    # Written, so that rows meet it without a grouping on the way and Spark can split a hot digest's rows.
    return stored(last.select("digest", F.col("top.id").alias("keep_id"), F.col("top.locator").alias("keep_locator"), "group_size"), "dedup-state")


def resolve(docs: DataFrame, state: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", place: Column, carry: bool = False, digest=sha256) -> DataFrame:
    """A row for each of docs: id, keep_id, group_size, kept, text_sha256 and, if asked for, row (all columns of docs).

    digest: what the digests of the state were made by; equal digests of unequal texts are told apart.
    """
    text = normal(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), place.alias("locator"), digest(text).alias("digest"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    carried = ["row"] if carry else []
    hit = F.col("group_size") > 1
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("text", 256)
    met = rows.join(state, "digest").select("id", "digest", "locator", "keep_id", "keep_locator", "group_size", sha.alias("text_sha256"), F.when(hit, F.col("text")).alias("text"), *carried)
    met = stored(met, "dedup-met")
    single = met.filter(~hit).select("id", "keep_id", "group_size", F.lit(True).alias("kept"), "text_sha256", *carried)
    hits = met.filter(hit)
    shares = F.ceil(F.col("group_size") / SPREAD).cast("int")
    kept = F.col("locator") == F.col("keep_locator")
    texts = hits.filter(kept).select("digest", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.col("text").alias("keep_text"))
    dealt = hits.withColumn("share", F.pmod(F.xxhash64("locator"), shares).cast("int"))
    compared = dealt.join(texts, ["digest", "share"]).select("id", "digest", "locator", "keep_id", "group_size", kept.alias("kept"), "text_sha256", (F.col("text") == F.col("keep_text")).alias("same"), *carried)
    compared = stored(compared, "dedup-compared")
    if not compared.filter(~F.col("same")).isEmpty():
        compared = _apart(compared, met)
    return single.unionByName(compared.select(*single.columns)).withColumnRenamed("id", id_col)


def _apart(compared: DataFrame, met: DataFrame) -> DataFrame:
    """compared after texts that only share a digest are put in groups of their own."""
    other = compared.filter(~F.col("same")).select("locator")
    texts = met.join(other, "locator", "left_semi").select("locator", "digest", "id", "text")
    group = texts.groupBy("digest", "text").agg(F.max(F.struct("id", "locator")).alias("top"), F.count(F.lit(1)).alias("n"))
    regrouped = texts.join(group, ["digest", "text"]).select("locator", F.col("top.id").alias("own_keep"), (F.col("top.locator") == F.col("locator")).alias("own_kept"), F.col("n"))
    away = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("away"))
    apart = ~F.col("same")
    return (
        compared.join(regrouped, "locator", "left")
        .join(away, "digest", "left")
        .withColumn("group_size", F.when(apart, F.col("n")).otherwise(F.col("group_size") - F.coalesce("away", F.lit(0))))
        .withColumn("keep_id", F.when(apart, F.col("own_keep")).otherwise(F.col("keep_id")))
        .withColumn("kept", F.when(apart, F.col("own_kept")).otherwise(F.col("kept")))
    )


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, digest=sha256, batches: int = 3) -> DataFrame:
    """docs, a table, as a stream of its own in about so many batches: digests are written first and streamed from there."""
    spark = docs.sparkSession
    docs, place = located(docs)
    folder = new_path(spark, "dedup")
    digests = docs.select(F.col(id_col).alias("id"), digest(normal(F.col(text_col))).alias("digest"), place.alias("locator"))
    digests.write.parquet(f"{folder}/digests")
    files = len(spark.read.schema(digests.schema).parquet(f"{folder}/digests").inputFiles())
    stream = spark.readStream.schema(digests.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{folder}/digests")
    return resolve(docs, digest_state(stream, folder), id_col=id_col, text_col=text_col, place=place, carry=carry, digest=digest)


def dedup_files(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", max_files: int = 10_000) -> DataFrame:
    """The Parquet files at path as a stream, max_files in a batch."""
    docs, place = located(spark.read.parquet(path))
    # A pattern, as a stream takes no path of a single file.
    two = docs.select(id_col, text_col).schema  # a stream's own fields go by name, so no others are read
    source = spark.readStream.schema(two).option("maxFilesPerTrigger", max_files).parquet(f"{path[:-1]}[{path[-1]}]")
    digests = source.select(F.col(id_col).alias("id"), sha256(normal(F.col(text_col))).alias("digest"), _place(F.col("_metadata")).alias("locator"))
    return resolve(docs, digest_state(digests, new_path(spark, "dedup")), id_col=id_col, text_col=text_col, place=place)
