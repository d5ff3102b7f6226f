"""A training corpus from raw documents: quality classifier, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, further ones too, whatever
they are called. Null and empty texts score 0 and go at the first stage; rows without an identifier
are below all others; of repeated rows one is left after the second. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionlake.llm import exact_dedup, packing, quality, simhash
from captionlake.llm.queries import table, vocabulary
from captionlake.llm.scratch import stored, unused

THRESHOLD = 0.5


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for quality reaches the threshold; the model learns from rows that aren't held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = unused("_quality", docs.columns)
    return quality.score(docs, model, score_col=score).filter(F.col(score) >= THRESHOLD).drop(score)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for A-Z in lower case, the one with the greatest doc_id."""
    return exact_dedup.dedup(docs, carry=True).filter("kept").select("row.*")


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar shingles of five words (0.8 or more), directly or by others, the one with the least doc_id."""
    own_id, own_of = unused("_id", docs.columns), unused("_of", docs.columns)
    gone = simhash.similar(docs, words=5, similarity=0.8).filter(~F.col("kept")).select(F.col("doc_id").alias(own_id), F.col("of").alias(own_of))
    of = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own_id)) & (of == F.col(own_of)), "left_anti")


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", dissimilar_documents),
    ("packing", packed_documents),
]

#: No SQL for a learned classifier, fingerprints and a tokenizer: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
