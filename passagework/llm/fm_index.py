"""An FM-index over integer sequences: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by doubling: ranks of 1, 2, 4, ... symbols until no two are equal."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width, order = 1, np.argsort(rank, kind="stable")
    while n and rank[order[-1]] < n - 1:
        behind = np.zeros(n, np.int64)
        behind[:n - width] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        width *= 2
    return order


class WaveletMatrix:
    """Ranks of every symbol by one bit array per binary digit; all queries are vectors."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        rest = symbols
        for b in reversed(range(self.bits)):
            bit = (rest >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(rest) - int(self.ones[-1][-1]))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands among the first ``upto`` places."""
        start, end = np.zeros_like(upto), upto
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = (symbol >> (self.bits - 1 - level)) & 1 == 1
            start = np.where(up, zeros + ones[start], start - ones[start])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Index of stretches of symbols 0..top-1, each closed by an end of its own, which no phrase can cross."""

    def __init__(self, stretches: np.ndarray, ends: np.ndarray, top: int, sample: int = 8):
        """``stretches``: all symbols with a place for every end; ``ends``: where those places are."""
        n = len(stretches)
        ordered = stretches.astype(np.int64)
        ordered[ends] = top + np.arange(len(ends))
        suffixes = suffix_array(ordered)
        symbols = np.minimum(ordered, top)
        self.last = symbols[suffixes - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.tree = WaveletMatrix(self.last, top)
        self.sampled = np.where((suffixes % sample == 0) | (self.last == top), suffixes, -1)
        self.size, self.top = n, top

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (low, high) of the suffixes that begin with each phrase; ``phrases`` is padded on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for k in range(width):
            live = np.flatnonzero((high > low) & (lengths > k))
            symbol = phrases[live, width - 1 - k]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back in the text until a sampled position."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        while len(open_rows := np.flatnonzero(self.sampled[rows] < 0)):
            row = rows[open_rows]
            symbol = self.last[row]
            rows[open_rows] = self.before[symbol] + self.tree.rank(symbol, row)
            steps[open_rows] += 1
        return self.sampled[rows] + steps
