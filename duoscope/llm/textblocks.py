"""Vectorised text handling for Arrow batches: blocks of bounded size, code points, word pieces and hashes.

Everything here works on one block of rows at a time, so memory depends on the block bound (or on the one text
that is longer than it), never on the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and row offsets into them; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes; a longer row has a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Block:
    """Some rows of a batch: their bytes, text, code points, and each row's first code point."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        self.raw = raw[offsets[lo] : offsets[hi]]
        self.byte_offsets = offsets[lo : hi + 1] - offsets[lo]
        self.text = self.raw.tobytes().decode("utf-8")
        self.cps = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        if len(self.cps) == len(self.raw):
            self.offsets = self.byte_offsets
        else:
            before = np.zeros(len(self.raw) + 1, np.int64)
            np.cumsum((self.raw & 0xC0) != 0x80, out=before[1:])
            self.offsets = before[self.byte_offsets]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    raw, offsets = text_bytes(column)
    for lo, hi in row_blocks(offsets, limit):
        yield Block(raw, offsets, lo, hi)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other, as the regex library has them."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            table[lo : hi + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def pieces(block: Block) -> np.ndarray:
    """First code point of each match of public_tokenizers.PATTERN, for all rows of the block at once.

    The pattern takes runs of one class; a space goes to the run after it, the last of several white-space
    characters is apart from the others, and the seven English endings are cut off after an apostrophe.
    """
    cps, n = block.cps, len(block.cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cps]
    first = np.zeros(n, bool)  # of a row
    first[block.offsets[:-1][block.offsets[:-1] < n]] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    end = np.append(run[1:], n)
    row_ends = np.append(first[1:], True)
    inner = (kind[run] == SPACE) & ~row_ends[end - 1]  # white space with a word after it
    last = end[inner] - 1
    start[last] = True
    start[last[cps[last] == 0x20] + 1] = False
    quote = run[(cps[run] == 0x27) & (end - run == 1) & ~row_ends[run]]
    quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
    if len(quote):
        a = cps[quote + 1]
        b = np.where(quote + 2 < n, cps[np.minimum(quote + 2, n - 1)], 0)
        b = np.where(row_ends[quote + 1], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for ending, size in ((quote[one], 2), (quote[two], 3)):
            start[ending + 1] = False
            after = ending + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


@lru_cache(4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER)
    out[0] = 1
    return np.cumprod(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of values; ranges are in order, not empty and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    longest = int(lengths.max())
    powers = _powers(1 << max(8, (longest - 1).bit_length()))
    if np.array_equal(starts[1:], ends[:-1]):
        values, at = values[starts[0] : ends[-1]], starts - starts[0]
    else:
        values, at = gather(values, starts, lengths)
    place = np.arange(len(values)) - np.repeat(at, lengths)
    terms = mix(values.astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(terms, at) + lengths.astype(np.uint64))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of values one after another, and where each begins."""
    at = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    total = int(at[-1] + lengths[-1]) if len(lengths) else 0
    return values[np.arange(total) + np.repeat(starts - at, lengths)], at


class PieceCache:
    """Token ids of word pieces, by the pieces' hashes: each new piece is encoded once.

    encode takes a list of distinct pieces and returns (ids, lengths). It lives as long as the Python worker and
    starts anew beyond `most` pieces, so its memory is bounded; the ids never depend on what it holds.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.ids = np.zeros(1 << 12, np.int32)
        self.starts, self.lengths, self.used = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def _put(self, keys: list[int], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.rows), len(keys)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < n + k:
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + k] = lengths
        self.starts[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.rows.update(zip(keys, range(n, n + k)))

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of the block, and each row's offset into them (one more than rows)."""
        start = pieces(block)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(block.offsets), np.int64)
        end = np.append(start[1:], len(block.cps))
        keys, first, back = np.unique(hashes(block.cps, start, end), return_index=True, return_inverse=True)
        if len(self.rows) + len(keys) > self.most:
            self.clear()
        known, names = self.rows, keys.tolist()
        new = [i for i, k in enumerate(names) if k not in known]
        if new:
            text, at = block.text, first[new]
            ids, lengths = self.encode([text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
            self._put([names[i] for i in new], ids, lengths)
        row = np.fromiter((known[k] for k in names), np.int64, len(names))[back]
        lengths = self.lengths[row]
        out, at = gather(self.ids, self.starts[row], lengths)
        piece_offset = np.append(at, len(out))
        return out, piece_offset[np.searchsorted(start, block.offsets)]
