"""Word shingles of texts: sorted distinct 64-bit hashes for each row of a block.

Words are maximal runs of letters and digits, compared in lower case. A text of fewer words than a shingle has one
shingle of all its words; a text without words has none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .textblocks import LETTER, NUMBER, Block, classes, hashes, mix

WORDS = 5


@lru_cache(1)
def _lower() -> np.ndarray:
    """Lower-case code point of each code point that has a single one."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


def words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the block, and each row's first word (one more than rows)."""
    kind = classes()[block.cps]
    inside = (kind == LETTER) | (kind == NUMBER)
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(len(block.offsets), np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = block.offsets[:-1]
    first = first[first < len(inside)]
    start[first] |= inside[first]
    stop = np.zeros(len(inside) + 1, bool)
    stop[1:] = inside
    stop[1:-1] &= ~inside[1:] | start[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop)
    return hashes(_lower()[block.cps], starts, ends), np.searchsorted(starts, block.offsets)


def shingles(block: Block, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending in each row; row offsets; a 64-bit key of each row's word sequence)."""
    word, at = words(block)
    n = len(at) - 1
    counts = np.diff(at)
    rolled = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for i in range(size):
        rolled = mix(rolled + word[i : i + len(rolled)] + np.uint64(i + 1)) if i else word[: len(rolled)] + np.uint64(1)
    sets, offsets, keys = [], np.zeros(n + 1, np.int64), np.zeros(n, np.uint64)
    for i in range(n):
        lo, c = int(at[i]), int(counts[i])
        if c >= size:
            own = rolled[lo : lo + c - size + 1]
        elif c:
            own = mix(np.array([np.bitwise_xor.reduce(mix(word[lo : lo + c] + np.arange(11, 11 + c, dtype=np.uint64)))]) + np.uint64(c))
        else:
            own = rolled[:0]
        keys[i] = np.add.reduce(mix(own ^ (np.arange(len(own), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))) if c else 0
        sets.append(np.unique(own))
        offsets[i + 1] = offsets[i] + len(sets[-1])
    return (np.concatenate(sets) if sets else rolled[:0]), offsets, keys
