"""Sets of word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from passagework.llm.text_bytes import column_bytes
from passagework.llm.words import LOWER, NOT_BLANK, SEED, mix, word_bounds, word_hashes

PLACE_CODES = SEED.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's shingles, one text after the other, and the offsets of each.

    Words are runs without blanks, A-Z in lower case.  A text of fewer words than ``width`` has its whole sequence as its
    one shingle, a text without words has none.
    """
    data, offsets = column_bytes(column)
    data = LOWER[data]
    starts, ends = word_bounds(data, offsets, NOT_BLANK)
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    n = max(len(hashes) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += hashes[k:k + n] * PLACE_CODES[k]
    rolled = mix(rolled + np.uint64(width))
    sets = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolled[a:b - width + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = (hashes[a:b] * PLACE_CODES[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
