"""Whole columns of text as byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a column that are worked on at once, however texts are cut by it.
WINDOW = 1 << 18


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other and the offsets of each; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def windows(offsets: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, texts, starts): the non-empty texts that lie in each window of bytes, and where they begin in it.

    A long text is in several windows, so that sums over texts need no memory of its length.
    """
    filled = np.flatnonzero(np.diff(offsets))
    begins, n = offsets[filled], int(offsets[-1])
    for low in range(0, n, size):
        high = min(n, low + size)
        first, last = np.searchsorted(begins, low, "right") - 1, np.searchsorted(begins, high, "left")
        yield low, high, filled[first:last], np.maximum(begins[first:last] - low, 0)
