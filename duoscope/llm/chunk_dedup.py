"""Substring dedup by content-defined chunks.

A gear rolling hash over the UTF-8 bytes sets the chunk bounds: its 32 bits depend on the last 8 bytes alone, and a
chunk begins after each byte whose hash is the least within HORIZON bytes on either side, so that an insertion moves
only the bounds around it. Least-value bounds are some 2 HORIZON bytes apart and seldom much more (gaps below a limit
would be spread like lifetimes), so that a passage of 51 short words, some 180 bytes, always has several. A stretch
without bounds is cut every MAX_CHUNK bytes from its last one. Each chunk has a 64-bit digest of its bytes and of the
8 bytes before it, which its bound depends on anyway; of equal chunks the first by (doc_id, position) stays. A run of
repeated chunks finds where a passage was seen before, and its ends are then extended byte by byte: the AROUND bytes
before the first chunk's first occurrence, and those after the last one's, are fetched from their texts and compared
with what stands here, as far as they are equal, in whole words. What goes are such stretches of MIN_WORDS words and more.

Digests that occur once are found by their counts and drop out before anything else moves; the occurrences of the
others meet their first one in equi-joins of stored tables, which AQE can split at a hot digest, after pre-aggregated
minima. Of the texts with first occurrences only the bytes around the ends of runs move.

Results: all columns of the input, text without the repeated runs (a null stays null), and n_chunks, n_repeated,
removed (UTF-8 bytes) and spans ("from-to" byte offsets in the old text, joined by ";"). A row is known by its id
and text: equal rows are alike and keep their text once per id. A text that is repeated as a whole becomes empty.
Rows of null id keep their text. If an output name is taken, ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .storage import cut
from .textblocks import hashes, mix, row_blocks, text_bytes

HORIZON = 12
MAX_CHUNK = 1024
MIN_WORDS = 25
AROUND = 256
LONG_WORD = 64
WINDOW = 8


@lru_cache(1)
def _gear() -> np.ndarray:
    return (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def rolled(raw: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of gear[b] << 4 x age over the last WINDOW bytes."""
    h = _gear()[raw].copy()
    for step in (1, 2, 4):
        h[step:] += h[:-step] << np.uint32(4 * step)
    return h


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The minimum of h[i : i + size] at each i that has so many."""
    width, out = 1, h
    while width * 2 <= size:
        out, width = np.minimum(out[:-width], out[width:]), width * 2
    return np.minimum(out[: len(h) - size + 1], out[size - width : len(h) - width + 1])


def bounds(raw: np.ndarray, offsets: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """First byte of each chunk of all texts; chunks don't cross texts and don't cut characters."""
    n, k = len(raw), HORIZON
    if not n:
        return np.zeros(0, np.int64)
    begin = np.unique(offsets[:-1][np.diff(offsets) > 0])
    starts = begin
    if n > 2 * k:
        h = rolled(raw) if h is None else h
        least = _least(h, k)  # least[i]: of h[i : i + k]
        middle = h[k : n - k]
        hit = np.flatnonzero((middle < least[: n - 2 * k]) & (middle <= least[k + 1 : n - k + 1])) + k
        of = np.searchsorted(begin, hit, side="right") - 1
        inside = (hit - begin[of] >= WINDOW - 1 + k) & (np.append(begin[1:], n)[of] - hit > k)
        hit = hit[inside] + 1
        while (cut_ := (raw[np.minimum(hit, n - 1)] & 0xC0) == 0x80).any():  # on to the next character
            hit = hit + cut_
        starts = np.union1d(begin, hit)
    sizes = np.diff(np.append(starts, n))
    if sizes.max() > MAX_CHUNK:
        long = np.flatnonzero(sizes > MAX_CHUNK)
        more = [np.arange(starts[i] + MAX_CHUNK, starts[i] + sizes[i], MAX_CHUNK) for i in long]
        more = np.concatenate(more)
        while (inside := (raw[more] & 0xC0) == 0x80).any():
            more = more - inside
        starts = np.union1d(starts, more)
    return starts


def digests(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, digest) of each chunk."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = rolled(raw)
    starts = bounds(raw, offsets, h)
    before = np.where(np.isin(starts, offsets), np.uint64(0), h[np.maximum(starts - 1, 0)].astype(np.uint64) + np.uint64(1))
    return starts, mix(hashes(raw, starts, np.append(starts[1:], len(raw))) ^ mix(before))


def _chunks():
    """(id, text key, text) to (id, text key, place, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for lo, hi in row_blocks(offsets):
                part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, digest = digests(part, at)
                row = np.searchsorted(at, starts, side="right") - 1
                place = np.arange(len(starts)) - np.searchsorted(starts, at)[row]
                of = pa.array(row + lo)
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(place.astype(np.int32)), pa.array(digest.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "place", "digest"])

    return run


def words_in(raw: bytes) -> int:
    return len(raw.split())


def _alike(a: bytes, b: bytes) -> int:
    """How many bytes two texts begin with in common."""
    n = min(len(a), len(b))
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) if x.any() else n


BLANKS = b" \t\r\n"


def extended(raw: bytes, lo: int, hi: int, before: bytes | None, after: bytes | None) -> tuple[int, int]:
    """raw[lo:hi] and what is beside it as beside its first occurrence, of which before and after are the bytes. Where it was extended it
    begins with what is a word in both texts, after a blank that stays, and ends after such a word or a blank; where there is
    no blank for LONG_WORD bytes, between characters."""
    if before:
        first = lo - _alike(raw[max(0, lo - len(before)) : lo][::-1], before[::-1])
        while first < lo and (raw[first] & 0xC0) == 0x80:
            first += 1
        there = len(before) - (lo - first)
        if (0 < first and raw[first - 1] not in BLANKS) or (0 < there and before[there - 1] not in BLANKS):
            first += next((i for i, c in enumerate(raw[first : min(first + LONG_WORD, hi)]) if c in BLANKS), 0)
        while 0 < first < hi and raw[first] in BLANKS:
            first += 1
        lo = first
    if after:
        last = hi + _alike(raw[hi : hi + len(after)], after)
        while last > hi and last < len(raw) and (raw[last] & 0xC0) == 0x80:
            last -= 1
        there = last - hi
        if (last < len(raw) and raw[last] not in BLANKS) or (there < len(after) and after[there] not in BLANKS):
            last -= next((i for i, c in enumerate(raw[max(lo, last - LONG_WORD) : last][::-1]) if c in BLANKS), 0)
        hi = last
    return lo, hi


def cut_runs(raw: bytes, starts: list[int], repeated: list[int], least: int = MIN_WORDS, before: dict[int, bytes] | None = None, after: dict[int, bytes] | None = None) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without its repeated stretches of `least` words, and their byte spans. before and after are the bytes around the
    first occurrence of a chunk that a run begins or ends with, by its place."""
    ends, before, after = [*starts[1:], len(raw)], before or {}, after or {}
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(repeated):
        first = i == 0 or repeated[i - 1] != c - 1
        last = i + 1 == len(repeated) or repeated[i + 1] != c + 1
        a, b = extended(raw, starts[c], ends[c], before.get(c) if first else None, after.get(c) if last else None)
        if spans and spans[-1][1] >= a:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    spans = [(a, b) for a, b in spans if words_in(raw[a:b]) >= least]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), spans


def _around():
    """(id, key, text, wanted (place, side)) to (id, key, place, side, bytes): those before a chunk (side 0) or after it (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for lo, hi in row_blocks(offsets):
                part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts = bounds(part, at)
                firsts = np.searchsorted(starts, at)
                out: list[tuple[int, int, int, bytes]] = []
                for i in range(hi - lo):
                    own = np.append(starts[firsts[i] : firsts[i + 1]], at[i + 1])
                    for w in batch.column(3)[lo + i].as_py():
                        if w["side"] == 0:
                            a, b = max(at[i], own[w["place"]] - AROUND), own[w["place"]]
                        else:
                            a, b = own[w["place"] + 1], min(at[i + 1], own[w["place"] + 1] + AROUND)
                        out.append((lo + i, w["place"], w["side"], part[a:b].tobytes()))
                of = pa.array([o[0] for o in out], pa.int64())
                columns = [pa.array([o[j] for o in out], t) for j, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *columns], ["id", "key", "place", "side", "bytes"])

    return run


NAMES = ("n_chunks", "n_repeated", "removed", "spans")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """Removes repeated passages from all texts; see the module for method and defined results."""
    taken = {c.lower() for c in df.columns}
    if clash := [c for c in (*NAMES, "__id", "__key", "__repeated", "__edges") if c in taken]:
        raise ValueError(f"the input already has columns {clash}")
    ship(df.sparkSession)
    known = [F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")]
    chunks = df.select(*known).filter("id is not null").mapInArrow(_chunks(), "id long, key long, place int, digest long")
    more = cut(chunks.groupBy("digest").count().filter("count > 1").select("digest"), "repeated", "zstd")
    met = cut(chunks.join(more, "digest", "left_semi"), "chunks", "zstd")
    first = cut(met.groupBy("digest").agg(F.min(F.struct("id", "key", "place")).alias("first")), "firsts", "zstd")
    later = met.join(first, "digest").filter(F.struct("id", "key", "place") > F.col("first"))
    hits = later.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("place", "first"))).alias("hits"))
    hits = cut(hits, "hits", "zstd")  # a row a text: no more than its chunks
    ahead = lambda step: lambda h, i: F.coalesce(F.get("hits", i + step)["place"], F.lit(-2)) != h["place"] + step
    edge = lambda side: F.transform(F.filter("hits", lambda h, i: F.when((i == 0) if side == 0 else F.lit(False), True).otherwise(ahead(2 * side - 1)(h, i))), lambda h: F.struct(h["place"].alias("place"), F.lit(side).alias("side"), h["first"].alias("first")))
    edges = cut(hits.select("id", "key", F.explode(F.concat(edge(0), edge(1))).alias("e")).select("id", "key", "e.*"), "edges", "zstd")
    wanted = edges.select("first.*", "side").distinct().groupBy("id", "key").agg(F.collect_list(F.struct("place", "side")).alias("wanted"))
    holding = df.select(*known).join(wanted, ["id", "key"]).select("id", "key", "text", "wanted")
    around = holding.mapInArrow(_around(), "id long, key long, place int, side int, bytes binary").groupBy("id", "key", "place", "side").agg(F.max("bytes").alias("bytes"))
    around = cut(around.select(F.struct("id", "key", "place").alias("first"), "side", "bytes"), "around", "zstd")
    told = edges.join(around, ["first", "side"]).groupBy("id", "key").agg(F.collect_list(F.struct("place", "side", "bytes")).alias("__edges"))
    places = hits.select("id", "key", F.transform("hits", lambda h: h["place"]).alias("__repeated")).join(told, ["id", "key"])
    own = df.withColumn("__id", F.col(key).cast("long")).withColumn("__key", F.xxhash64(text))
    places = places.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "__repeated", "__edges")
    ready = own.join(places, ["__id", "__key"], "left").drop("__id", "__key").select(*df.columns, "__repeated", "__edges")
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in NAMES[:3]), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, repeated, edges_ = batch.column(text), batch.column("__repeated"), batch.column("__edges")
            raw, offsets = text_bytes(column)
            for lo, hi in row_blocks(offsets):
                part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts = bounds(part, at)
                firsts = np.searchsorted(starts, at)
                texts, rows = [], []
                for i in range(hi - lo):
                    again = repeated[lo + i].as_py()
                    own_starts = (starts[firsts[i] : firsts[i + 1]] - at[i]).tolist()
                    if again and column[lo + i].is_valid:
                        old = part[at[i] : at[i + 1]].tobytes()
                        beside = edges_[lo + i].as_py()
                        new, spans = cut_runs(old, own_starts, again, least, *({e["place"]: e["bytes"] for e in beside if e["side"] == side} for side in (0, 1)))
                        texts.append(new.decode())
                        rows.append((len(own_starts), len(again), len(old) - len(new), ";".join(f"{a}-{b}" for a, b in spans)))
                    else:
                        texts.append(column[lo + i].as_py())
                        rows.append((len(own_starts), 0, 0, ""))
                some = batch.slice(lo, hi - lo)
                old_columns = [pa.array(texts, pa.string()) if c == text else some.column(c) for c in df_columns]
                new_columns = [pa.array(v, pa.int64() if i < 3 else pa.string()) for i, v in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([*old_columns, *new_columns], [*df_columns, *NAMES])

    df_columns = df.columns
    return ready.mapInArrow(run, schema)
