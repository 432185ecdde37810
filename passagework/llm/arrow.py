"""Helpers of functions that run over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that a batch of results may have before it is handed on.
ROWS = 4096
#: Bytes of text that are worked on together; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker hands freed memory back: it lives on, and other stages' workers stand beside it."""
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return bounded


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with :func:`lean`, whatever characters the columns' names hold."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(lean(named), schema)


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict]], Iterable[tuple]], ddl: str | StructType) -> DataFrame:
    """Run ``rows`` over the records of each partition as dicts; its tuples become rows of ``ddl``.

    Records are streamed: no more than one incoming and one outgoing batch is held.
    """
    return map_batches(df, lambda batches: rows(r for b in batches for part in pieces(b) for r in part.to_pylist()), ddl)


def map_batches(df: DataFrame, tuples: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]], ddl: str | StructType) -> DataFrame:
    """Run ``tuples`` over the Arrow batches of each partition; the tuples that it yields become rows of ``ddl``."""
    schema = schema_of(ddl) if isinstance(ddl, str) else ddl

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        return gather(tuples(batches), arrow)

    return arrow_map(df, run, schema)


def gather(tuples: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROWS`` rows and about ``SLICE_BYTES`` bytes of strings."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for t in tuples:
        held.append(t)
        size += sum(len(v) for v in t if isinstance(v, (str, bytes, list)))
        if len(held) >= ROWS or size >= SLICE_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def pieces(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes, so that Python copies of long texts stay few."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
