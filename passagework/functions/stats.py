"""Aggregates with the rounding and empty-input rules the reports need, and exact percentiles at scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from passagework.functions.text import col
from passagework.sources.lineage import cut

#: Distinct values that the last ordered step of a percentile may hold.
SLICE_ROWS = 50_000


def rate(numerator, denominator, digits: int = 2) -> Column:
    """Percentage; null when the denominator is 0."""
    return F.round(F.try_divide(F.lit(100.0) * col(numerator), col(denominator)), digits)


def mean_skip_null(c) -> Column:
    return F.round(F.avg(col(c)), 4)


def count_if(c) -> Column:
    return F.coalesce(F.count_if(col(c)), F.lit(0))


@F.pandas_udf(S.LongType())
def _ordered_bits(v: pd.Series) -> pd.Series:
    """64 bits of each number that rise, read without a sign, as the number does; both zeros alike, NaN last."""
    bits = np.where(v == 0, 0.0, v.to_numpy(np.float64)).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits, bits ^ np.iinfo(np.int64).min))


def _narrow(df: DataFrame, keys: list[str], shift: int, small) -> DataFrame:
    """One refinement: of each target's slice keep the part, by the next twelve bits, that holds its rank."""
    placed = df.withColumn("b", F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(4095)))
    w = Window.partitionBy(*keys, "t").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        placed.groupBy(*keys, "t", "b").agg(F.sum("n").alias("bn"), F.first("r").alias("r"))
        .withColumn("before", F.coalesce(F.sum("bn").over(w), F.lit(0)))
        .filter((F.col("r") > F.col("before")) & (F.col("r") <= F.col("before") + F.col("bn")))
        .select(*keys, "t", "b", "before")
    )
    return placed.join(small(hist), [*keys, "t", "b"]).select(
        *keys, "t", "v", "u", "n", (F.col("r") - F.col("before")).alias("r")
    )


def order_statistics(df: DataFrame, value: str, targets: list[Column], keys: list[str] | None = None,
                     slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Exact k-th smallest values, found by refining histograms of the values' bits.

    ``targets`` are expressions over ``n`` (the non-null count of the key) giving 1-based ranks.  Equal values are
    counted together first (partial aggregation absorbs hot values) and written once.  Each round keeps, per target, the
    part of the slice that holds it, by twelve more bits, until every slice has at most ``slice_rows`` distinct values;
    after six rounds a slice is one value, however the values lie.  So the last ordered step is bounded.
    """
    whole, keys = not keys, list(keys or ["__all"])
    if whole:
        df = df.withColumn("__all", F.lit(0))
    counted = cut(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("u", _ordered_bits("v")))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("n"))
    ranks = total.select(
        *keys, F.posexplode(F.array(*[t.cast("bigint") for t in targets])).alias("t", "r"))
    # Ungrouped, the helper tables hold one row per target.  Grouped, they hold one per key and target and carry no
    # hint: adaptive execution broadcasts them when they prove small and splits hot keys when they do not.
    small = F.broadcast if whole else (lambda df: df)
    largest = counted.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    base = counted.join(small(ranks), keys)
    for shift in (52, 40, 28, 16, 4, 0):
        if largest <= slice_rows:
            break
        base = cut(_narrow(base, keys, shift, small))
        largest = base.groupBy(*keys, "t").count().agg(F.max("count")).first()[0] or 0
    w = Window.partitionBy(*keys, "t").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return (
        base.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .filter((F.col("r") > F.col("before")) & (F.col("r") <= F.col("before") + F.col("n")))
        .select(*([] if whole else keys), "t", "v")
    )


def percentile_nearest(df: DataFrame, value: str, ps: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles, ``sorted[ceil(p*n)-1]``, 2 decimals; one column per entry of ``ps``; 0 if empty."""
    keys = keys or []
    names = list(ps)
    targets = [F.greatest(F.ceil(F.lit(ps[k]) * F.col("n")), F.lit(1)) for k in names]
    stats = order_statistics(df, value, targets, keys)
    cells = [F.coalesce(F.round(F.max(F.when(F.col("t") == i, F.col("v"))), 2), F.lit(0.0)).alias(k)
             for i, k in enumerate(names)]
    return stats.groupBy(*keys).agg(*cells)


def percentile_linear(df: DataFrame, value: str, ps: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Linearly interpolated percentiles at position ``(n-1)*p``, 2 decimals; null if empty."""
    keys = keys or []
    names = list(ps)
    targets = []
    for k in names:
        pos = (F.col("n") - 1) * F.lit(ps[k])
        targets += [F.floor(pos) + 1, F.ceil(pos) + 1]
    stats = order_statistics(df, value, targets, keys)
    whole, keys = not keys, list(keys or ["__all"])
    if whole:
        stats = stats.withColumn("__all", F.lit(0))
        # Ungrouped, so that an empty input still gives its row of nulls.
        n = df.agg(F.count(value).alias("n")).withColumn("__all", F.lit(0))
    else:
        n = df.groupBy(*keys).agg(F.count(value).alias("n"))
    wide = stats.groupBy(*keys).agg(*[F.max(F.when(F.col("t") == i, F.col("v"))).alias(f"q{i}")
                                      for i in range(len(targets))])
    joined = n.join(wide, keys, "left")
    out = []
    for j, k in enumerate(names):
        pos = (F.col("n") - 1) * F.lit(ps[k])
        lo, hi = F.col(f"q{2 * j}"), F.col(f"q{2 * j + 1}")
        out.append(F.round(lo + (hi - lo) * (pos - F.floor(pos)), 2).alias(k))
    return joined.select(*([] if whole else keys), *out)
