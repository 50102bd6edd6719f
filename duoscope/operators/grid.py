"""Exact nearest neighbours over adaptive boxes: no pair of rows, and no pair of boxes, is met that can't matter.

Reference points lie along a space-filling curve through ranks (so that boxes are small where points are dense), cut into
boxes of some BOX points. Each distinct place of the other side goes to its nearest box first, which bounds the distance of
its k-th neighbour; then, in rounds of growing rings, to the next nearest boxes that come within that bound, and is done
when none is left. Boxes and places meet in equi-joins on the box; inside a task, blocks of a box that lie too far are
skipped. Work is in proportion to the rows, and memory is a few boxes.

Of the points of one place only the first k + 1 by key can be neighbours of anything, and rows of one place share their
neighbours; so a place that a third of all rows have is a few points here. The bounds of all boxes, the only thing every
task gets, are at most MOST_BOXES rows: boxes grow with the table beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from ..sources.tables import stored

BOX = 2048
MOST_BOXES = 1 << 15
BLOCK = 256  # points of a box whose distance is bounded together
PLACES = 1024  # places that travel together
FEW = 128  # places whose distances are computed together
QUANTILES = 256
RINGS = [1, 16, 128, 1024, MOST_BOXES]  # boxes that a place may have met after each round


def curve(ranks: np.ndarray) -> np.ndarray:
    """The place of points (row, axis) in the unit cube along a Z-shaped curve."""
    axes = ranks.shape[1]
    bits = min(24, 62 // axes)
    cells = np.clip((ranks * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    out = np.zeros(len(ranks), np.int64)
    for b in range(bits):
        for a in range(axes):
            out |= ((cells[:, a] >> b) & 1) << (b * axes + a)
    return out


def between(low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) squared distance of each box low..high to each box lo..hi; a point is a box of its own."""
    near, far = np.zeros((len(low), len(lo))), np.zeros((len(low), len(lo)))
    for a in range(low.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, a] - high[:, None, a], low[:, None, a] - hi[None, :, a]), 0.0)
        span = np.maximum(np.abs(hi[None, :, a] - low[:, None, a]), np.abs(high[:, None, a] - lo[None, :, a]))
        near += gap * gap
        far += span * span
    return near, far


def within(places: np.ndarray, bound: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, point, squared distance) of each place's k nearest points, none beyond its bound; equals by the points' order."""
    span = np.ptp(points, axis=0)
    order = np.argsort(curve((points - points.min(0)) / np.where(span > 0, span, 1.0)), kind="stable")
    starts = np.arange(0, len(points), BLOCK)
    lo, hi = np.minimum.reduceat(points[order], starts), np.maximum.reduceat(points[order], starts)
    ends = np.append(starts[1:], len(points))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def gaps(own: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.sort(np.concatenate([order[starts[i] : ends[i]] for i in which]))
        d = np.zeros((len(own), len(some)))
        for a in range(own.shape[1]):
            gap = own[:, a, None] - points[None, some, a]
            d += gap * gap
        return some, d

    for first in range(0, len(places), FEW):
        own, most = places[first : first + FEW], bound[first : first + FEW].copy()
        near, _ = between(own.min(0)[None], own.max(0)[None], lo, hi)
        nearest = np.argsort(near[0], kind="stable")
        some, d = gaps(own, nearest[: 1 + k // BLOCK + 1])
        if len(some) >= k:
            most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
        wanted = np.flatnonzero(near[0] <= most.max())
        if not len(wanted):
            continue
        some, d = gaps(own, wanted)
        row, col = np.nonzero(d <= most[:, None])
        dist = d[row, col]
        best = np.lexsort((col, dist, row))
        row, col, dist = row[best], col[best], dist[best]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((first + row[keep], some[col[keep]], dist[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _finite(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return out


def _along(df: DataFrame, names: list[str], quantiles: list[np.ndarray]) -> DataFrame:
    """df with `_code`, the place along the curve through the ranks that the quantiles give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = np.stack([np.interp(batch.column(n).to_numpy(zero_copy_only=False), q, np.linspace(0, 1, len(q))) for n, q in zip(names, quantiles)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve(ranks), pa.int64())], [*batch.schema.names, "_code"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_code", T.LongType())]))


def _route(state: DataFrame, names: list[str], bounds, met: int, upto: int) -> DataFrame:
    """Rows (box, places and their bounds as arrays): for each place the boxes from the met-th to the upto-th nearest within its bound."""
    axes = len(names)
    schema = T.StructType([T.StructField("_box", T.LongType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in [*names, "_bound"])])

    def boxes_of(x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, lo, hi = bounds.value
        near, far = between(x.min(0)[None], x.max(0)[None], lo, hi)
        most = bound.max()
        if upto < len(lo):
            most = min(most, np.partition(far[0], upto - 1)[upto - 1])  # upto boxes lie within it of every place
        some = np.flatnonzero(near[0] <= most)
        d, _ = between(x, x, lo[some], hi[some])
        order = np.argsort(d, axis=1, kind="stable")[:, met:upto]
        row, col = np.nonzero(np.take_along_axis(d, order, 1) <= bound[:, None])
        return row, some[order[row, col]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = bounds.value[0]
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            bound = batch.column("_bound").to_numpy(zero_copy_only=False)
            for at in range(0, len(x), PLACES):
                found = [(at + lo + row, box) for lo in range(0, len(x[at : at + PLACES]), FEW) for row, box in [boxes_of(x[at + lo : at + min(lo + FEW, PLACES)], bound[at + lo : at + min(lo + FEW, PLACES)])]]
                row, box = (np.concatenate(v) for v in zip(*found))
                if not len(row):
                    continue
                order = np.argsort(box, kind="stable")
                row, box = row[order], box[order]
                starts = np.flatnonzero(np.append(True, box[1:] != box[:-1]))
                offsets = pa.array(np.append(starts, len(box)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[row])) for v in [*(x[:, a] for a in range(axes)), bound]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[box[starts]], pa.int64()), *lists], schema.names)

    return state.repartitionByRange("_code").sortWithinPartitions("_code").select(*names, "_bound").mapInArrow(run, schema)


def _meet(routed: DataFrame, boxes: DataFrame, names: list[str], k: int, fields: list[T.StructField]) -> DataFrame:
    """(place, _found): the k nearest points of a box for each place sent to it."""
    point = T.StructType([T.StructField("_d", T.DoubleType()), *fields])
    schema = T.StructType([*(T.StructField(n, T.DoubleType()) for n in names), T.StructField("_found", T.ArrayType(point))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places = np.stack([np.asarray(batch.column(n)[i].values) for n in names], 1)
                points = batch.column("_points")[i].values
                at = np.stack([points.field(n).to_numpy(zero_copy_only=False) for n in names], 1)
                row, which, d = within(places, np.asarray(batch.column("_bound")[i].values), at, k)
                taken = points.take(pa.array(which))
                offsets = pa.array(np.searchsorted(row, np.arange(len(places) + 1)), pa.int32())
                values = pa.StructArray.from_arrays([pa.array(d), *(taken.field(f.name) for f in fields)], ["_d", *(f.name for f in fields)])
                yield pa.RecordBatch.from_arrays([*(pa.array(places[:, a]) for a in range(len(names))), pa.ListArray.from_arrays(offsets, values)], schema.names)

    return routed.join(boxes, "_box").drop("_box").mapInArrow(run, schema)


def nearest(left: DataFrame, right: DataFrame, columns: list[str], k: int, key: str = "idx", exclude_self: bool = True, carry: list[str] | None = None) -> DataFrame:
    """(key, neighbour, distance, carried columns, place): the k nearest right rows of each left row, ties by key.

    Keys are unique on the right. Rows with a coordinate that is null or not finite have no neighbours and are none's.
    """
    spark, carry = left.sparkSession, carry or []
    ship(spark)
    names, many = [f"_x{i}" for i in range(len(columns))], k + bool(exclude_self)
    place = [(F.col(c).cast("double") + 0.0).alias(n) for c, n in zip(columns, names)]
    right = right.select(F.col(key).alias("_k"), *place, *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry))).filter(_finite(names))
    own = left.select(F.col(key), *place).filter(_finite(names))
    fields = [right.schema["_k"], *(right.schema[f"_c{i}"] for i in range(len(carry)))]
    result = [F.col(key), F.col("_f._k").alias("neighbour"), F.sqrt("_f._d").alias("distance"), *(F.col(f"_f._c{i}").alias(c) for i, c in enumerate(carry)), (F.col("_p") + 1).alias("place")]

    shares = F.array(*(F.lit(i / QUANTILES) for i in range(QUANTILES + 1)))
    told = right.agg(F.count("*").alias("n"), *(F.percentile_approx(n, shares, F.lit(4 * QUANTILES)).alias(n) for n in names)).first()  # one row
    if not told["n"]:
        return own.withColumn("_f", F.lit(None).cast(T.StructType([T.StructField("_d", T.DoubleType()), *fields]))).withColumn("_p", F.lit(0)).filter("false").select(*result)
    quantiles = [np.unique(np.array(told[n], float)) for n in names]
    quantiles = [q if len(q) > 1 else np.array([q[0], q[0] + 1.0]) for q in quantiles]

    size = max(BOX, -(-told["n"] // MOST_BOXES))
    first = F.row_number().over(Window.partitionBy(*names).orderBy("_k"))
    points = _along(right.withColumn("_n", first).filter(F.col("_n") <= many).drop("_n"), names, quantiles)
    ranged = points.repartitionByRange("_code").sortWithinPartitions("_code").withColumn("_m", F.monotonically_increasing_id())
    row_bits = (1 << 33) - 1
    box = F.shiftright("_m", 33) * F.lit(1 << 33) + F.floor(F.col("_m").bitwiseAND(F.lit(row_bits)) / size)
    numbered = stored(ranged.select(box.alias("_box"), *(f.name for f in fields), *names), "points")
    boxes = stored(numbered.groupBy("_box").agg(F.array_sort(F.collect_list(F.struct("_k", *names, *(f.name for f in fields[1:])))).alias("_points")), "boxes")
    ends = [f(F.transform("_points", lambda p: p[n])).alias(f"{n}{w}") for w, f in (("lo", F.array_min), ("hi", F.array_max)) for n in names]
    rows = sorted(map(tuple, boxes.select("_box", *ends).collect()))  # a row a box, MOST_BOXES and a few
    corners = np.array([r[1:] for r in rows], float).reshape(len(rows), 2, len(names))
    bounds = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), corners[:, 0], corners[:, 1]))

    empty = F.lit(None).cast(T.ArrayType(T.StructType([T.StructField("_d", T.DoubleType()), *fields])))
    state = stored(_along(own.select(*names).distinct(), names, quantiles).withColumns({"_bound": F.lit(float("inf")), "_found": empty}), "places")
    met = 0
    for upto in [*RINGS, len(rows)]:
        if met >= len(rows):
            break
        routed = _route(state, names, bounds, met, min(upto, len(rows)))
        if met:
            routed = stored(routed, "routed")
            if routed.isEmpty():
                break
        more = _meet(routed, boxes, names, many, fields).withColumns({"_code": F.lit(None).cast("long"), "_bound": F.lit(None).cast("double")})
        every = state.unionByName(more).groupBy(*names).agg(F.max("_code").alias("_code"), F.slice(F.array_sort(F.flatten(F.collect_list("_found"))), 1, many).alias("_found"))
        bound = F.when(F.size("_found") >= many, F.get(F.col("_found"), F.lit(many - 1))["_d"]).otherwise(float("inf"))
        state, met = stored(every.select(*names, "_code", bound.alias("_bound"), "_found"), "places"), min(upto, len(rows))

    found = own.join(state.select(*names, "_found"), names)
    others = F.filter("_found", lambda f: f["_k"] != F.col(key)) if exclude_self else F.col("_found")
    return found.select(F.col(key), F.posexplode(F.slice(others, 1, k)).alias("_p", "_f")).select(*result)
