"""N-gram Jaccard self-join by chosen paths.

Each text is the set of its distinct shingles of five words; two texts are linked at a Jaccard similarity of 0.8 or
more. Texts of equal word sequences are copies and go through as one representative.

1. Chosen paths: in each run a set descends to a child for every shingle whose hash with the path is below
   1 / (threshold x size), so a pair at the threshold shares one child in the mean at each level: it is parted at the
   first level with probability 1/e, before the third with 0.63, as a branching process of mean 1 dies out. There are
   as many runs as reach the recall TARGET for a pair that is just similar enough and has to go all DEPTH levels deep
   (runs_for(); 14 by default); more similar pairs, and those in small buckets, are missed less. Paths of DEPTH levels
   are made in one pass over the texts. A bucket of one set is done; one of at most BUCKET sets is compared by brute force. In a larger one a
   random set, the pivot, is compared with the others: where half of them have an estimate of DENSE or more, more
   shingles would not part them, and the bucket is compared whole, in pairs of blocks, once for all buckets that
   hold the same sets. The other large buckets are split by the next shingles of their sets; what is large at the
   last level is compared in pairs of blocks too, so no bucket is capped.
2. Brute force in a bucket compares one-permutation sketches, lets through whatever may be above the threshold
   (4.5 standard deviations), and emits a star for each component, not its pairs.
3. Exact check: within each component of these candidates, every pair of texts is compared by its whole shingle
   sets, again in blocks. That finds the links of each text, and with them the classes.

Results: one row per input row: doc_id, class_id (the least doc_id of its connected component), n_links (other rows
that are linked to it, copies included), n_shingles. A null text, or one without words, has no shingles: it is a
class of its own without links. Rows that repeat a doc_id are copies if their words are the same, else texts of their own:
each has its own links, and a class is named by the least doc_id in it. Rows of null doc_id
come back with a null class. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .components import components
from .shingles import WORDS, shingles
from .storage import cut
from .textblocks import blocks, gather, mix

THRESHOLD = 0.8
TARGET = 0.998
DEPTH = 3
BUCKET = 128
BINS = 128
DENSE = 0.4
BLOCK = 1024
VERIFY_ROWS = 512
VERIFY_BYTES = 8 << 20
_SEED = 0x51ED270B


def runs_for(target: float = TARGET, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold shares a bucket of the last level with probability `target`."""
    if not 0 < target < 1:
        raise ValueError("a recall is between 0 and 1")
    parted = 0.0
    for _ in range(depth):  # a Poisson number of children, of mean 1, of which all have died out
        parted = math.exp(parted - 1)
    return math.ceil(math.log(1 - target) / math.log(parted))


def _seed(*parts: int) -> np.uint64:
    x = np.array([_SEED], np.uint64)
    for p in parts:
        x = mix(x + np.array([p], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return x[0]


def _limits(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Below it, a hash chooses its shingle; at most the whole range."""
    return np.minimum(1 / (threshold * np.maximum(sizes, 1)), 1.0) * float(2**53)


def _children(flat: np.ndarray, limit: np.ndarray, path: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the chosen shingles and the paths of their children."""
    h = mix(flat ^ path)
    at = np.flatnonzero((h >> np.uint64(11)) < limit.astype(np.uint64))
    return at, mix(h[at] + np.uint64(0xA5A5))


def sketch(flat: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One byte a bin: of the least hash that falls in it, from 1 to 255; 0 is an empty bin."""
    n = len(offsets) - 1
    h = mix(flat + np.uint64(77))
    cell = np.repeat(np.arange(n), np.diff(offsets)) * bins + (h >> np.uint64(40)).astype(np.int64) % bins
    out = np.full(n * bins, np.iinfo(np.uint64).max)
    np.minimum.at(out, cell, h & np.uint64((1 << 40) - 1))
    some = out != np.iinfo(np.uint64).max
    return np.where(some, (mix(out) % np.uint64(255) + np.uint64(1)).astype(np.uint8), 0).astype(np.uint8).reshape(n, bins)


def _lists(values: np.ndarray, owners: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(owners, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(owners, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[order].view(np.int64), pa.int64()))


def _first(flat: np.ndarray, limit: np.ndarray, owner: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paths, rows, paths above) of the first level, for all runs."""
    paths, owners = [], []
    for r in range(runs):
        at, child = _children(flat, limit, _seed(1, r))
        paths.append(child)
        owners.append(owner[at])
    return np.concatenate(paths), np.concatenate(owners), np.zeros(0, np.uint64)


def _next(flat: np.ndarray, offsets: np.ndarray, limit: np.ndarray, paths: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paths, rows, paths above) of the level below."""
    made, rows, above = [], [], []
    sizes = np.diff(offsets)
    order = np.argsort(owners, kind="stable")
    paths, owners = paths[order], owners[order]
    for lo in range(0, len(paths), 4096):  # so many paths at once, each with all shingles of its row
        own = owners[lo : lo + 4096]
        values, at = gather(flat, offsets[:-1][own], sizes[own])
        which = np.repeat(np.arange(len(own)), sizes[own])
        found, child = _children(values, limit[offsets[own]][which], paths[lo : lo + 4096][which])
        made.append(child)
        rows.append(own[which[found]])
        above.append(paths[lo : lo + 4096][which[found]])
    none = np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) if x else e for x, e in ((made, none), (rows, none.astype(np.int64)), (above, none)))


def _describe(threshold: float, size: int, runs: int):
    """(id, text) to (id, key, second key, n, sketch, paths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                flat, offsets, keys = shingles(b, size)
                n, sizes = b.hi - b.lo, np.diff(offsets)
                limit = np.repeat(_limits(sizes, threshold), sizes)
                owner = np.repeat(np.arange(n), sizes)
                levels = [_first(flat, limit, owner, runs)]
                for _ in range(1, DEPTH):
                    levels.append(_next(flat, offsets, limit, *levels[-1][:2]))
                second = np.zeros(n, np.uint64)
                some = sizes > 0
                if some.any():
                    second[some] = np.bitwise_xor.reduceat(mix(flat + np.uint64(5)), offsets[:-1][some])
                marks = sketch(flat, offsets)
                columns = [
                    batch.column(0).slice(b.lo, n), pa.array(keys.view(np.int64)), pa.array(second.view(np.int64)), pa.array(sizes.astype(np.int64)),
                    pa.array([m.tobytes() for m in marks], pa.binary()),
                ]
                names = ["id", "key", "second", "n", "sketch"]
                for i, (paths, owners, above) in enumerate(levels, 1):
                    columns.append(_lists(paths, owners, n))
                    names.append(f"paths{i}")
                    if i > 1:
                        columns.append(_lists(above, owners, n))
                        names.append(f"above{i}")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which no group of the sorted key is cut; one group more than a batch is held at most."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if kept and (last or np.asarray(kept[-1].column(key))[-1] != keys[0]):
            if np.asarray(kept[-1].column(key))[-1] != keys[0] and not last:
                yield pa.Table.from_batches(kept)
                kept = []
            else:
                yield pa.Table.from_batches([*kept, batch.slice(0, last)] if last else kept)
                kept = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        kept.append(batch.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


def _compare(threshold: float):
    """(bucket, id, n, sketch) sorted by bucket, to a star (a, b) for each component of similar sketches in a bucket."""

    def stars(table: pa.Table) -> pa.RecordBatch:
        bucket = table["bucket"].to_numpy()
        ids, sizes = table["id"].to_numpy(), table["n"].to_numpy()
        marks = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), BINS)
        one, two = [], []
        for d in range(1, len(ids)):
            i = np.flatnonzero(bucket[d:] == bucket[:-d])
            if not len(i):
                break
            j = i + d
            small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
            fit = (small >= threshold * large) & (ids[i] != ids[j])
            i, j = i[fit], j[fit]
            for lo in range(0, len(i), 1 << 14):
                x, y = marks[i[lo : lo + (1 << 14)]], marks[j[lo : lo + (1 << 14)]]
                used = ((x != 0) | (y != 0)).sum(1)
                same = ((x == y) & (x != 0)).sum(1)
                ok = np.flatnonzero(same >= threshold * used - 4.5 * np.sqrt(threshold * (1 - threshold) * used))
                one.append(i[lo + ok])
                two.append(j[lo + ok])
        a = np.concatenate(one) if one else np.zeros(0, np.int64)
        b = np.concatenate(two) if two else a
        label = np.arange(len(ids))
        while len(a):
            low = np.minimum(label[a], label[b])
            if (low == label[a]).all() and (low == label[b]).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
        off = np.flatnonzero(label != np.arange(len(ids)))
        pairs = np.unique(np.stack([ids[off], ids[label[off]]], 1), axis=0) if len(off) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy(), pa.int64()), pa.array(pairs[:, 1].copy(), pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            yield stars(table)

    return run


def _to_pivot():
    """(bucket, id, n, sketch, pivot, mark) to (bucket, id, pivot, near): the estimate for the pivot's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, BINS) for c in ("sketch", "mark"))
            used = ((x != 0) | (y != 0)).sum(1)
            near = ((x == y) & (x != 0)).sum(1) / np.maximum(used, 1)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("id"), batch.column("pivot"), pa.array(near)], ["bucket", "id", "pivot", "near"])

    return run


def _verify(threshold: float, size: int):
    """(cell, side, id, copies, text) sorted by cell, to (id, links, other): exact links of each text in its cell."""

    def links(ids: np.ndarray, side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = len(ids)
        sizes = np.array([len(s) for s in sets])
        _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[back] > 1
        row = np.repeat(np.arange(n), sizes)[shared]
        column = np.unique(back[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((n, n), np.float32)
        width = max(256, (1 << 21) // n)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            x = np.zeros((n, width), np.float32)
            x[row[a:b], column[a:b] - lo] = 1
            common += x @ x.T
        union = sizes[:, None] + sizes[None, :] - common
        near = common >= threshold * union - 1e-6
        near &= (side[:, None] != side[None, :]) if side[0] else ~np.eye(n, dtype=bool)
        count = near @ copies
        label = np.arange(n)
        while True:
            low = np.minimum(label, np.where(near, label[None, :], n).min(1))
            if (low == label).all():
                return count, ids[label]
            label = low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cells, sides = table["cell"].to_numpy(), table["side"].to_numpy()
            ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
            sets = []
            for b in blocks(table["text"].combine_chunks()):
                flat, offsets, _ = shingles(b, size)
                sets += [flat[x:y] for x, y in zip(offsets, offsets[1:])]
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            found, others = np.zeros(len(ids), np.int64), ids.copy()
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo > 1:
                    order = np.argsort(ids[lo:hi], kind="stable")
                    got, other = links(ids[lo:hi][order], sides[lo:hi][order], copies[lo:hi][order], [sets[lo + i] for i in order])
                    found[lo + order], others[lo + order] = got, other
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found), pa.array(others)], ["id", "links", "other"])

    return run


def _blocked(df: DataFrame, group: str, n_blocks, name: str):
    """Rows for each pair of blocks of their group: `name` is the pair's key; `side` is 0 in a block with itself, else 1 or 2."""
    own = F.pmod(F.xxhash64(F.lit(11), "id"), F.col("n_blocks"))
    df = df.withColumn("n_blocks", n_blocks).withColumn("own", own)
    df = df.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    return df.withColumn("side", F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2)).withColumn(name, F.xxhash64(group, low, high)).drop("n_blocks", "own", "with")


def _apart(df: DataFrame, key: str, text: str, threshold: float, size: int, target: float) -> DataFrame:
    """near_duplicates() where an id has several texts: each (id, text) goes through by a number of its own."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    several = docs.filter("id is not null").groupBy("id").agg((F.min("hash") != F.max("hash")).alias("several")).filter("several")
    coded = docs.join(several, "id", "left").withColumn("own", F.when(F.col("several"), F.xxhash64("id", "hash")).otherwise(F.col("id")))
    found = cut(near_duplicates(coded.select("own", "text"), "own", "text", threshold, size, target), "apart")
    names = cut(coded.filter("id is not null").select("own", "id").distinct(), "names")
    named = found.filter("own is not null").join(names, "own")
    least = cut(named.groupBy("class_id").agg(F.min("id").alias("least")), "least")
    out = named.join(least, "class_id").select(F.col("id").alias(key), F.col("least").alias("class_id"), "n_links", "n_shingles")
    return out.union(found.filter("own is null").select(F.col("own").alias(key), "class_id", "n_links", "n_shingles"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = WORDS, target: float = TARGET) -> DataFrame:
    """Classes and numbers of links of all rows; see the module for method and defined results."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    arrays = "".join(f", paths{i} array<long>" + (f", above{i} array<long>" if i > 1 else "") for i in range(1, DEPTH + 1))
    told = cut(docs.filter("id is not null").mapInArrow(_describe(threshold, size, runs_for(target)), f"id long, key long, second long, n long, sketch binary{arrays}"), "sets")
    copies = cut(told.groupBy("key", "second", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "copies")
    chosen = copies.filter("n > 0").select(F.col("rep").alias("id"), "copies")
    content = F.struct("key", "second", "n")
    ids = told.groupBy("id").agg(F.count("*").alias("rows"), (F.min(content) != F.max(content)).alias("several"))
    ids = ids.agg(F.max("rows").alias("rows"), F.max("several").alias("several")).first()  # one row
    if ids["several"]:
        return _apart(df, key, text, threshold, size, target)
    reps = told.drop("key", "second").join(chosen, "id")
    reps = reps.dropDuplicates(["id"]) if ids["rows"] and ids["rows"] > 1 else reps
    marks = reps.select("id", "n", "sketch")

    rows = reps.select("id", F.explode("paths1").alias("bucket"))
    # stored, so that the join's two sides are plain exchanges, which AQE can split at a hot bucket
    shared = cut(rows.groupBy("bucket").count().filter("count > 1"), "counts")
    met = cut(rows.join(shared, "bucket"), "buckets")
    leaves, large, blocked = [met.filter(F.col("count") <= BUCKET).select("bucket", "id")], met.filter(F.col("count") > BUCKET), []
    if not large.isEmpty():
        pivots = large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "id").alias("h"), "id"))["id"].alias("pivot"))
        # stored, as is what else meets the rows of hot buckets or components
        pivots = cut(pivots.join(marks.select(F.col("id").alias("pivot"), F.col("sketch").alias("mark")), "pivot"), "pivots")
        near = large.select("bucket", "id").join(marks.select("id", "sketch"), "id").join(pivots, "bucket").mapInArrow(_to_pivot(), "bucket long, id long, pivot long, near double")
        dense = near.groupBy("bucket").agg(F.avg((F.col("near") >= DENSE).cast("double")).alias("share")).filter("share >= 0.5")
        dense = cut(dense.select("bucket"), "dense")
        blocked.append(large.join(dense, "bucket", "left_semi").select("bucket", "id"))
        for level in range(2, DEPTH + 1):
            # the large buckets of each set, at most some runs / threshold^level of them
            split = large.join(dense, "bucket", "left_anti") if level == 2 else large
            above = split.groupBy("id").agg(F.collect_set("bucket").alias("large"))
            pairs = F.filter(F.arrays_zip(F.col(f"above{level}").alias("above"), F.col(f"paths{level}").alias("path")), lambda x: F.array_contains("large", x["above"]))
            below = above.join(reps.select("id", f"above{level}", f"paths{level}"), "id").select("id", F.explode(F.transform(pairs, lambda x: x["path"])).alias("bucket"))
            below = cut(below, "below")
            shared = cut(below.groupBy("bucket").count().filter("count > 1"), "counts")
            counted = cut(below.join(shared, "bucket"), "buckets")
            leaves.append(counted.filter(F.col("count") <= BUCKET).select("bucket", "id"))
            large = counted.filter(F.col("count") > BUCKET)
            if large.isEmpty():
                break
        else:
            blocked.append(large.select("bucket", "id"))
    for part in blocked:
        heads = cut(part.groupBy("bucket").agg(F.min("id").alias("b")), "heads")
        groups = components(part.join(heads, "bucket").select(F.col("id").alias("a"), "b")).select(F.col("node").alias("id"), F.col("component").alias("group"))
        counted = groups.join(groups.groupBy("group").count(), "group")
        leaves.append(_blocked(counted, "group", F.ceil(F.col("count") / BLOCK), "bucket").select("bucket", "id"))
    found = leaves[0]
    for part in leaves[1:]:
        found = found.union(part)
    buckets = found.join(marks, "id").repartition("bucket").sortWithinPartitions("bucket")
    candidates = components(buckets.mapInArrow(_compare(threshold), "a long, b long"))

    members = candidates.withColumnRenamed("node", "id").join(chosen, "id").join(docs, "id").dropDuplicates(["id"])
    members = cut(members, "members")
    of = members.groupBy("component").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    n_blocks = F.greatest(F.ceil(F.col("rows") / VERIFY_ROWS), F.ceil(F.col("bytes") / VERIFY_BYTES))
    cells = _blocked(members.join(of, "component"), "component", n_blocks, "cell").select("cell", "side", "id", "copies", "text")
    exact = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify(threshold, size), "id long, links long, other long")
    exact = cut(exact, "links")
    links = exact.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(exact.select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = copies.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("key", "second", "n", F.when(F.col("n") > 0, F.coalesce("component", "rep")).alias("class_id"), F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = told.select("id", "key", "second", "n").join(known, ["key", "second", "n"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
    lost = docs.filter("id is null").select(F.col("id").alias(key), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_shingles"))
    return out.union(lost)
