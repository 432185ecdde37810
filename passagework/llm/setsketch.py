"""SetSketch: registers of exponentially spaced truncated minima, and the likelihood of a joint estimate."""

from __future__ import annotations

import numpy as np

from passagework.llm.words import mix

#: Registers, ratio of neighbouring register values, rate of the exponential variables.
REGISTERS = 256
BASE = 1.001
RATE = 20.0

FRACTION = 40


def registers(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers (unsigned 16 bits) of every set; ``elements`` are well mixed hashes, one set after the other.

    An element reaches every register once, in an order of its own, and the k-th value it offers lies in the k-th of
    ``REGISTERS`` intervals of equal probability of the exponential distribution.  So values rise with k, and a set is
    done when its greatest minimum lies below the next interval.  Registers of a union are the maxima of registers.
    """
    sets = len(offsets) - 1
    least = np.full(sets * REGISTERS, (REGISTERS << FRACTION) - 1, np.int64)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    place = (elements & np.uint64(REGISTERS - 1)).astype(np.int64)
    stride = ((elements >> np.uint64(8)) & np.uint64(REGISTERS - 1)).astype(np.int64) | 1
    for k in range(REGISTERS):
        if not len(elements):
            break
        value = (k << FRACTION) + (mix(elements + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - FRACTION)).astype(np.int64)
        np.minimum.at(least, owner * REGISTERS + place, value)
        place = (place + stride) % REGISTERS
        done = least.reshape(sets, REGISTERS).max(axis=1) < (k + 1) << FRACTION
        if done.any():
            on = ~done[owner]
            elements, owner, place, stride = elements[on], owner[on], place[on], stride[on]
    share = (least.astype(np.float64) + 0.5) / (REGISTERS << FRACTION)
    value = -np.log1p(-share) / RATE
    found = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype(np.uint16).reshape(sets, REGISTERS)
    found[np.diff(offsets) == 0] = 0
    return found


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every ``rows`` neighbouring registers of each sketch."""
    bands = sketch.shape[1] // rows
    parts = sketch[:, :bands * rows].astype(np.uint64).reshape(len(sketch), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    for k in range(rows):
        keys = mix(keys * np.uint64(65537) + parts[:, :, k])
    return keys


def jaccard_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches whose set sizes are known.

    The counts of registers that are greater in a, greater in b, and equal are multinomial; their probabilities follow
    from the similarity.  The log likelihood is concave in it, so a ternary search over its range finds the maximum.
    """
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    total = size_a + size_b
    u, v = size_a / total, size_b / total
    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        first, second = p(u - v * j), p(v - u * j)
        return up * np.log(first + 1e-12) + down * np.log(second + 1e-12) + same * np.log(np.maximum(1 - first - second, 1e-12))

    for _ in range(30):
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2
