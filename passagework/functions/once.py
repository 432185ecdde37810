"""Columns computed exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add or replace columns so that costly expressions run a single time.

    Spark pushes a filter on a computed column below the projection and copies the whole expression into it at
    every mention.  For long text expressions that multiplies the work; a one-row generator is a border no filter
    crosses.
    """
    kept = [F.col(c) for c in df.columns if c not in cols]
    made = F.inline_outer(F.array(F.struct(*[e.alias(n) for n, e in cols.items()])))
    return df.select(*kept, made)
