"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two joins on small rows; what each makes, and the grouped side that it joins, is
written to the shared folder, which cuts the lineage. The driver sees one row a round: the number of links and a sum of their hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionlake.llm.scratch import delete, new_path


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _written(links: DataFrame, made: list[str]) -> DataFrame:
    made.append(new_path(links.sparkSession, "links"))
    links.write.parquet(made[-1])
    return links.sparkSession.read.schema(links.schema).parquet(made[-1])


def _star(links: DataFrame, large: bool, made: list[str]) -> DataFrame:
    """Links each node's greater (large) or smaller (small) neighbours, and itself, to its least neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    # Written first, so that no grouping stands in the join and Spark can split the rows of a star's centre.
    least = _written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), made)
    met = both.join(least, "a")
    moved = met.filter("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b of any one ordered type, no nulls. Columns node, root: every node but the roots, once.

    The root of a component is its least node. Links from a node to itself and repeats don't matter.
    """
    spark = links.sparkSession
    made: list[str] = []
    now = _written(links.select("a", "b").filter("a <> b").distinct(), made)
    seen = _sum(now)
    while seen[0]:
        for large in (True, False):
            now = _written(_star(now, large, made), made)
            for path in made[:-1]:
                delete(spark, path)
            del made[:-1]
        if (after := _sum(now)) == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
