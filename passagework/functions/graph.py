"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.sources.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``edges`` (a, b) that is not a root itself.

    Nodes are values of any type with an order.  Large-star and small-star in turn: neighbours move to ever smaller nodes,
    in a number of rounds that grows with the logarithm of a component's size.  Minima are combined before they are
    shuffled, and every round is a table.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))

    def stars(e: DataFrame) -> bool:
        """Whether every node has one parent at most, and no parent has one itself: then parents are the roots."""
        roles = e.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            e.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        roles = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        return roles.filter((F.col("child") > 1) | ((F.col("child") == 1) & (F.col("parent") == 1))).isEmpty()

    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not stars(now):
        two = both(now)
        large = two.join(least(two), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = least(large)
        small = large.join(down, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(down.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
