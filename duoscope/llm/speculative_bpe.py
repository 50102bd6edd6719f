"""BPE encoding by guess and check: the longest known token at each place, then a test of every adjacent pair.

A text is cut into the pieces of the byte-level pre-tokenizer; each distinct piece of a worker is encoded once. Greedy
longest match proposes its tokens. A sequence of tokens is the one that merging gives if and only if each adjacent pair
is what merging gives for the two alone: the first merge across a boundary, if there were one, would have to happen
between the last part of the left token and the first part of the right one, while both are there. These parts are the
right spine of the left token's merge tree and the left spine of the right one's; all pairs of a block are walked
together, undoing the later of the two merges each step. Pieces with a pair that fails are merged exactly, by a heap.
Decoding gathers the tokens' bytes. Nothing shuffles; a lost executor costs only the tasks it ran.

Defined results: a null or empty text has no tokens and decodes to an empty text; texts of any length are encoded whole,
in time that grows as length x log(length); the literal of an added token in a text is that token, as it is by the
library's default; truncation and padding are not used; null ids decode to an empty text, and bytes that are no UTF-8
to U+FFFD. Other columns pass through, a clash of names raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..runtime import ship
from .textblocks import Block, PieceCache, blocks, gather

NEVER = np.int64(1 << 40)  # the rank of a merge that doesn't happen


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Model:
    """Merges and vocabulary of a plain byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE model")
        special = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("added tokens that take blanks or whole words are not known")
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.ids = {t: i for i, t in self.bytes_of.items()}
        self.added = {t["content"]: t["id"] for t in special}
        self.literal = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.of_byte = [self.ids[bytes([b])] for b in range(256)]
        size = max([*self.bytes_of, *self.added.values()]) + 1

        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # a pair's rank and what it becomes
        self.left, self.right, self.rank = np.full(size, -1), np.full(size, -1), np.full(size, -1, np.int64)
        of = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = of[a + b]
            self.merges[of[a], of[b]] = rank, made
            if self.left[made] >= 0 or rank < max(self.rank[of[a]], self.rank[of[b]]):
                raise ValueError("a token has two merges, or one before its parts")  # the pair test needs one tree a token
            self.left[made], self.right[made], self.rank[made] = of[a], of[b], rank
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.pairs = size, keys[order]
        self.pair_rank = np.array([r for r, _ in self.merges.values()], np.int64)[order]

        # a token is only proposed if merging its own bytes gives it; made from its parts up, by the same pair test
        made = np.flatnonzero(self.left >= 0)
        sound = self.fit(self.left[made], self.right[made], own=self.rank[made])
        broken = set(made[~sound].tolist())
        for i in made[np.argsort(self.rank[made])].tolist():
            if int(self.left[i]) in broken or int(self.right[i]) in broken:
                broken.add(i)
        single = set(self.of_byte)
        self.known = {t: i for t, i in self.ids.items() if i not in broken and (self.left[i] >= 0 or i in single)}
        self.longest = np.zeros(256, np.int64)  # of the tokens that begin with a byte
        for t in self.known:
            self.longest[t[0]] = max(self.longest[t[0]], len(t))
        self.longest = self.longest.tolist()

        texts = self.bytes_of | {i: t.encode() for t, i in self.added.items()}
        self.lengths = np.array([len(texts.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(texts.get(i, b"") for i in range(size)), np.uint8)
        self.in_use = np.isin(np.arange(size), np.fromiter(texts, np.int64))
        self.cache = PieceCache(self.encode_pieces)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each a with its b, NEVER if there is none."""
        keys = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_rank[at], NEVER) if len(self.pairs) else np.full(len(keys), NEVER)

    def fit(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of each token a and its b gives the two tokens again (`own`: ... before that merge of the two).

        The parts r of a and l of b beside the boundary are there together until the earlier of the two is merged further,
        inwards, at the ranks r_until and l_until. The pair (r, l) would be merged across if its rank is below r_until and not
        above l_until: of equal ranks the left place goes first.
        """
        ok = np.ones(len(a), bool)
        row = np.arange(len(a))
        r, l = a.astype(np.int64), b.astype(np.int64)
        r_until, l_until = (np.full(len(a), NEVER) if own is None else own.astype(np.int64).copy() for _ in range(2))
        while len(row):
            q = self.rank_of(r, l)
            crossed = (q < r_until) & (q <= l_until) & (q < NEVER)
            ok[row[crossed]] = False
            made_r, made_l = self.rank[r], self.rank[l]
            more = ~crossed & (np.maximum(made_r, made_l) >= 0)
            back = made_r > made_l  # undo the later merge
            both = made_r == made_l
            r_until, l_until = np.where(back | both, made_r, r_until), np.where(~back | both, made_l, l_until)
            r, l = np.where(back | both, self.right[r], r), np.where(~back | both, self.left[l], l)
            row, r, l, r_until, l_until = row[more], r[more], l[more], r_until[more], l_until[more]
        return ok

    def propose(self, word: bytes) -> list[int]:
        """The longest known token at each place."""
        whole = self.known.get(word)
        if whole is not None:
            return [whole]
        out, at, n, known, longest = [], 0, len(word), self.known, self.longest
        while at < n:
            end = min(n, at + longest[word[at]])
            while (token := known.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def encode_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each distinct piece."""
        raw = [w.encode() for w in words]
        found = [self.propose(w) for w in raw]
        lengths = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.int64)
        word = np.repeat(np.arange(len(found)), lengths)
        beside = np.flatnonzero(word[1:] == word[:-1])
        fits = self.fit(flat[beside], flat[beside + 1])
        failed = np.unique(word[beside[~fits]]).tolist()
        if not failed:
            return flat.astype(np.int32), lengths
        for i in failed:
            found[i] = self.merge(raw[i])
            lengths[i] = len(found[i])
        return np.array([i for x in found for i in x], np.int32), lengths

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one piece: the pair of least rank, the leftmost of equals, until there is none."""
        token = [self.of_byte[b] for b in word]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(m[0], i, token[i], token[i + 1]) for i in range(n - 1) if (m := merges.get((token[i], token[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue  # one of the two has become part of another token
            token[i], token[j] = merges[a, b][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((token[i], token[k])):
                    heapq.heappush(heap, (m[0], i, token[i], token[k]))
            if (p := before[i]) >= 0 and (m := merges.get((token[p], token[i]))):
                heapq.heappush(heap, (m[0], p, token[p], token[i]))
        return [t for t in token if t >= 0]

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and each row's offset into them."""
        if self.literal is None or not self.literal.search(block.text):
            return self.cache.block(block)
        at, parts, given, row = block.offsets.tolist(), [], [], []
        for i, (lo, hi) in enumerate(zip(at, at[1:])):  # a text is cut at the literals of added tokens, and each part encoded alone
            text, end = block.text[lo:hi], 0
            for m in self.literal.finditer(text):
                parts += [text[end : m.start()], ""]
                given += [-1, self.added[m[0]]]
                row += [i, i]
                end = m.end()
            parts.append(text[end:])
            given.append(-1)
            row.append(i)
        raw = [p.encode() for p in parts]
        inner = Block(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(p) for p in raw])), 0, len(raw))
        ids, offsets = self.cache.block(inner)
        fixed = np.array(given)
        lengths = np.where(fixed >= 0, 1, np.diff(offsets))
        out = np.insert(ids, offsets[:-1][fixed >= 0], fixed[fixed >= 0]).astype(np.int32)
        total = np.bincount(np.array(row), weights=lengths, minlength=len(at) - 1).astype(np.int64)
        return out, np.append(0, np.cumsum(total))

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each row's ids; an id outside the vocabulary is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.in_use[ids].all()):
            raise ValueError("a token id is not in the vocabulary")
        if not len(ids):
            return [""] * (len(offsets) - 1)
        lengths = self.lengths[ids]
        raw, _ = gather(self.letters, self.starts[ids], lengths)
        at = np.append(0, np.cumsum(lengths))[offsets].tolist()
        whole = raw.tobytes()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


@lru_cache(2)
def model(path: str) -> Model:
    """One per worker and file."""
    return Model(path)


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    clash = {f.name.lower() for f in fields} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the input already has a column {', '.join(sorted(clash))}; choose another output name")
    return T.StructType([*df.schema.fields, *fields])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with the token ids of each text as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for b in blocks(batch.column(text)):
                values, offsets = own.encode_block(b)
                part = batch.slice(b.lo, b.hi - b.lo)
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, ids])

    ship(df.sparkSession)
    return df.mapInArrow(run, _with(df, T.StructField(ids, T.ArrayType(T.IntegerType()))))


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the text that each row's ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            column = batch.column(ids)
            counts = np.asarray(column.value_lengths().fill_null(0))
            values = np.asarray(column.flatten(), np.int64) if len(column) else np.zeros(0, np.int64)
            got = own.decode_rows(values, np.append(0, np.cumsum(counts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, out])

    ship(df.sparkSession)
    return df.mapInArrow(run, _with(df, T.StructField(out, T.StringType())))


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, and the SHA-256 of the ids (as little-endian 32-bit integers) and of the text decoded from them.

    The codings of encode() and decode() over the same blocks, without the ids crossing to the JVM between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for b in blocks(batch.column(text)):
                values, offsets = own.encode_block(b)
                decoded = own.decode_rows(values.astype(np.int64), offsets)
                raw, at = memoryview(values.astype("<u4").tobytes()), (offsets * 4).tolist()
                columns = [
                    batch.column(key).slice(b.lo, b.hi - b.lo),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(at, at[1:])], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], *fields]))
