"""Ordered numbering that never needs a whole key in one task.

A plain ``row_number() over (partition by key)`` sends one key to one task, which a key holding a third of the
rows would stall.  Here rows are dealt by sampled ranges of (key, order), so a large key is many blocks however its order
values lie: each block is numbered on its own, and only one total per block travels to the window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.sources.lineage import cut


def running_total(df: DataFrame, keys: list[str], order: str, value, out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all earlier rows of the same key (0 for the first row).

    ``order`` must be unique within a key, or its ties must not matter.  The dealt rows are a table, so that both readers
    see the same blocks.
    """
    blk = "__block"
    dealt = df.withColumn("__v", value.cast("bigint")).repartitionByRange(*keys, order)
    work = cut(dealt.withColumn(blk, F.spark_partition_id()))
    inside = Window.partitionBy(*keys, blk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        work.groupBy(*keys, blk)
        .agg(F.sum("__v").alias("__t"))
        .select(*keys, blk, F.coalesce(F.sum("__t").over(across), F.lit(0)).alias("__ahead"))
    )
    local = work.withColumn("__local", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return (
        local.join(bases, [*keys, blk])
        .withColumn(out, F.col("__ahead") + F.col("__local"))
        .select(*df.columns, out)
    )


def row_numbers(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """1-based position of each row within its key, by the unique column ``order``."""
    return running_total(df, keys, order, F.lit(1), "__before").withColumn(
        out, F.col("__before") + 1
    ).drop("__before")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows of each key.

    The rank filter makes Spark cut every input partition to ``k`` rows per key before the shuffle, so a hot key
    sends at most ``k`` rows per partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
