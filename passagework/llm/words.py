"""Words of many texts at once: boundaries and 64-bit hashes over byte arrays."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Bytes of words in lower-cased UTF-8.  Letters, digits and all beyond ASCII; and everything but white space.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False

SEED = np.random.default_rng(20240607)
BYTE_CODES = SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of lower-cased ``data``; words end at the texts' ends given by ``offsets``."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cut = np.zeros(len(data), bool)
    cut[inner] = True
    starts = np.flatnonzero(inside & (~before | cut))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:] & ~cut[1:]
    return starts, np.flatnonzero(inside & ~after) + 1


#: Words that are hashed at once: their bytes take ten times their size meanwhile.
HASH_WORDS = 1 << 15


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word: a polynomial over random byte codes, mixed."""
    if len(starts) > HASH_WORDS:
        return np.concatenate([word_hashes(data, starts[k:k + HASH_WORDS], ends[k:k + HASH_WORDS]) for k in range(0, len(starts), HASH_WORDS)])
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(sizes.max()), STEP, np.uint64))])
    terms = BYTE_CODES[data[np.repeat(starts, sizes) + within]] * powers[within]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64))
