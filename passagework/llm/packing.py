"""Packing into sequences of fixed length: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.arrow import map_rows
from passagework.llm.tokens import encoder

#: Pieces, and their ids, that a task packs together before it goes on with new windows.
BUFFER_PIECES = 100_000
BUFFER_IDS = 16 << 20


class OpenWindows:
    """Open windows by remaining capacity.  A segment tree over 0..size counts them, so the tightest window that still
    takes a piece is found by one walk to the leftmost non-empty leaf at or right of the piece's length."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]
        self.opened = 0

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node //= 2

    def tightest(self, need: int) -> int | None:
        """The least capacity >= ``need`` that an open window has."""
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None

    def place(self, length: int) -> tuple[int, int]:
        """Window number and offset of a piece of ``length``; opens a window where none takes it."""
        capacity = self.tightest(length)
        if capacity is None:
            capacity, window = self.size, self.opened
            self.opened += 1
        else:
            window = self.windows[capacity].pop()
            self._change(capacity, -1)
        if left := capacity - length:
            self.windows[left].append(window)
            self._change(left, 1)
        return window, self.size - capacity


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[tuple[int, int]], int]:
    """(window, offset) of every length, and the number of windows; equal lengths in the given order."""
    open_windows = OpenWindows(size)
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        placed[k] = open_windows.place(lengths[k])
    return placed, open_windows.opened


def groups(records: Iterator[dict], chars: int = 1 << 20) -> Iterator[list[dict]]:
    """Records in lists of about ``chars`` characters of text."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r["text"] or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``size`` ids.

    A document is its ids and ``end_id``; null text counts as empty, every row of ``docs`` is a document of its own.
    A document longer than ``size`` is first cut into full windows, its rest is packed with the others.  One row per
    piece: ``doc_id``, ``start`` in the document, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    in the sequence, and with ``with_ids`` the ``ids`` as little-endian 32-bit integers.  Other columns are not read.

    Every task packs what it reads, so nothing is shuffled and a task holds one bounded buffer; only its last windows
    stay partly empty.  Sequence numbers are the partition's number and a running number, the same on every retry.
    """
    ddl = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
           + ", ids binary" * with_ids)

    def rows(records: Iterator[dict]) -> Iterator[tuple]:
        words = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []
        ids_held = 0

        def packed() -> Iterator[tuple]:
            nonlocal first
            placed, opened = best_fit_decreasing([p[2] for p in held], size)
            for (doc, start, n, crc, total, ids), (window, offset) in zip(held, placed):
                yield doc, start, n, crc, total, first + window, offset, *[ids] * with_ids
            first += opened

        for some in groups(records):
            for r, text_ids in zip(some, words.encode_all([r["text"] or "" for r in some])):
                ids = text_ids + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start:4 * (start + size)]
                    held.append((r["doc_id"], start, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None))
                ids_held += total * with_ids
            if len(held) >= BUFFER_PIECES or ids_held >= BUFFER_IDS:
                yield from packed()
                held, ids_held = [], 0
        words.forget()
        yield from packed()

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, ddl)


def sequences(pieces: DataFrame) -> DataFrame:
    """The training sequences of :func:`pack` with ids: ``sequence_id`` and ``ids`` joined by offset."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
