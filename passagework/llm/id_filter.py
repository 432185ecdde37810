"""Bounded filters of ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.arrow import arrow_map

#: Bits of an id filter: 8 MB whatever the number of ids.
FILTER_BITS = 26


def id_filter(ids: DataFrame, column: str):
    """A function of an array of ids that is true for every id of ``ids`` and for few others.

    A bit map of fixed size, built by grouped aggregation; it saves moving rows whose id is not in the table, a join behind
    it decides.  Null ids are never in it.  Ids are hashed as the type that ``ids`` has, to which those of other tables are cast.
    """
    spark = ids.sparkSession
    hashed = F.pmod(F.xxhash64(F.col(column).cast(ids.schema[column].dataType)), F.lit(1 << FILTER_BITS))
    words = ids.filter(F.col(column).isNotNull()).select(F.shiftright(hashed, 5).alias("w"), F.expr(
        "1L").alias("one"), F.pmod(hashed, F.lit(32)).cast("int").alias("k"))
    got = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, k)")).alias("bits")).toArrow()
    table = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    table[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(table)
    return hashed, shared


def split_by_filter(rows: DataFrame, ids: DataFrame, column: str, inside: bool) -> DataFrame:
    """Rows of ``rows`` that the filter of ``ids`` (a table with ``column``) lets pass, or those it does not (null ids too)."""
    hashed, shared = id_filter(ids, column)
    marked = rows.withColumn("_id_place", hashed)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            place = batch.column(len(names)).fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column(names.index(column)).is_valid().to_numpy(zero_copy_only=False)
            found = (table[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1
            kept = (found & known) == inside
            yield pa.RecordBatch.from_arrays(batch.columns[:len(names)], names=names).filter(pa.array(kept))

    return arrow_map(marked, run, rows.schema)
