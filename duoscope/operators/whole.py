"""Estimators over whole tables: many fits at once, one job a step.

A table's rows carry their features, blocks, views and a hash as arrays. In a step every task adds up what each fit needs of
its rows (estimators' sums()), the sums of all fits meet in one aggregate, and the driver makes the next parameters, K x D
numbers a fit. Fits that have settled drop out. All K, starts, replicates and macro clusters go through the same steps: a fit
may be confined to the rows of a macro cluster, and a replicate weighs each row by a Poisson number of its hash.

Partitions of a minimum size have a price for each region, by which a row's distance to it is reduced: a region that is too
small gets the least price at which it has its size. That price is an order statistic of the rows' margins, found by
counting them in ever finer bins. Rows of one place are told apart by a jitter of their hash.

Starts of k-means are drawn from the whole table too (spread_centres()): a row's place in a race is by its hash and its
squared distance, and one pass tells who is first in the races of all fits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from ..sources.tables import stored
from . import estimators as E

BINS = 2048
NARROWED = 6  # passes of bins at most: a bin is then the BINS**NARROWED-th part of the first range
DRAWN = 0.8  # a replicate draws this share of the rows, with repeats


@dataclass
class Data:
    """Rows in memory."""

    x: np.ndarray
    seen: np.ndarray | None = None  # blocks, for masked estimators
    blocks: E.Blocks | None = None
    views: np.ndarray | None = None  # (view, row, axis), for the latent mixture
    view_seen: np.ndarray | None = None
    quadrants: np.ndarray | None = None
    patterns: np.ndarray | None = None  # which views a row has
    plane: np.ndarray | None = None
    hashes: np.ndarray | None = None
    groups: np.ndarray | None = None  # whose rows they are, for fits of groups

    def columns_seen(self) -> np.ndarray | None:
        return None if self.seen is None or self.blocks is None else np.repeat(self.seen, [hi - lo for lo, hi in self.blocks], axis=1)

    def take(self, rows: np.ndarray) -> Data:
        of = lambda a, axis=0: None if a is None else np.take(a, rows, axis)
        return Data(of(self.x), of(self.seen), self.blocks, of(self.views, 1), of(self.view_seen, 1), of(self.quadrants), of(self.patterns), of(self.plane), of(self.hashes), of(self.groups))


def uniforms(hashes: np.ndarray, salts: list[int]) -> np.ndarray:
    """(row, salt): numbers from 0 up to 1 by a row's hash and a salt."""
    z = hashes.astype(np.uint64)[:, None] + np.array([(0x9E3779B97F4A7C15 * (s + 1)) % (1 << 64) for s in salts], np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def replicate_weights(hashes: np.ndarray, run: int) -> np.ndarray:
    """A Poisson number of mean DRAWN for each row, by its hash and the run."""
    u = uniforms(hashes, [run])[:, 0]
    terms = np.cumprod(np.append(1.0, DRAWN / np.arange(1, 20)))
    return np.searchsorted(np.cumsum(terms * np.exp(-DRAWN)), u, side="right").astype(float)


@dataclass
class Table:
    """Rows of arrays: _x, _seen (blocks), _views, _there, _plane, and _q (quadrant), _pattern, _h (hash of the key); _g (group) if fits are of groups."""

    rows: DataFrame
    blocks: E.Blocks | None
    size: int

    @staticmethod
    def of(spark: SparkSession, data: Data) -> Table:
        """Rows in memory as a table; their places are their keys."""
        n = len(data.x) if data.x is not None else data.views.shape[1]
        lists = lambda a, width, fill: [fill] * n if a is None else np.asarray(a).reshape(n, width).tolist()
        flat = lambda v: None if v is None else np.moveaxis(v, 0, 1).reshape(n, -1)
        frame = pd.DataFrame({
            "_k": [str(i) for i in range(n)], "_x": lists(data.x, -1, []), "_seen": lists(data.seen, -1, []), "_views": lists(flat(data.views), 4, []), "_there": lists(flat(data.view_seen), 2, []),
            "_plane": lists(data.plane, 2, []), "_q": [-1] * n if data.quadrants is None else data.quadrants, "_pattern": [-1] * n if data.patterns is None else data.patterns,
        })
        rows = spark.createDataFrame(frame, "_k string, _x array<double>, _seen array<boolean>, _views array<double>, _there array<boolean>, _plane array<double>, _q int, _pattern int")
        return Table(dealt(rows.withColumn("_h", F.xxhash64("_k"))), data.blocks, n)

    def sample(self, limit: int, seed: int) -> Data:
        """At most `limit` rows, the first by a hash of the key, ordered by it; the limit is a documented bound."""
        order = F.xxhash64(F.lit(seed), "_k")
        frame = self.rows.orderBy(order, "_k").limit(limit).toPandas()
        return as_data({c: frame[c] for c in frame}, self.blocks)

    def held(self, seed: int) -> Data:
        """All rows, in the order of sample(); for tables that are known to be small."""
        return self.sample(self.size, seed)


def dealt(rows: DataFrame) -> DataFrame:
    """A table's rows, stored in parts by their hash: where they come from one large file, each step would be a single task."""
    return stored(rows.repartition("_h"), "rows")


def as_data(columns: dict, blocks: E.Blocks | None) -> Data:
    """Rows in memory of the arrays of a batch, of which all but _h may be left out."""

    def matrix(name: str, kind: type) -> np.ndarray | None:
        if name not in columns:
            return None
        column = columns[name]
        n = len(column)
        if isinstance(column, (pa.Array, pa.ChunkedArray)):
            flat = column.flatten().to_numpy(zero_copy_only=False)
        else:
            flat = np.concatenate([np.asarray(v) for v in column]) if n else np.zeros(0)
        return flat.astype(kind).reshape(n, -1) if len(flat) else None

    flat = lambda name: np.asarray(columns[name]) if name in columns else np.full(len(columns["_h"]), -1)
    x, views, there = matrix("_x", float), matrix("_views", float), matrix("_there", bool)
    n = len(columns["_h"])
    views = None if views is None else np.moveaxis(views.reshape(n, 2, 2), 1, 0)
    there = None if there is None else there.T
    if views is not None and there is not None:
        views = np.where(there[:, :, None], np.nan_to_num(views), 0.0)
    q, pattern = flat("_q"), flat("_pattern")
    return Data(np.zeros((n, 0)) if x is None else x, matrix("_seen", bool), blocks, views, there, None if (q < 0).all() else q, None if (pattern < 0).all() else pattern, matrix("_plane", float), flat("_h"), flat("_g") if "_g" in columns else None)


# ---------------------------------------------------------------- models and their rows

Model = E.Diagonal | E.Latent | E.TwoLevel | E.Nested | E.Partition


def predicted(model: Model, data: Data) -> np.ndarray:
    """Labels of rows."""
    if isinstance(model, E.Latent):
        return model.predict(data.views, data.view_seen)
    if isinstance(model, E.Diagonal):
        return model.predict(data.x, data.columns_seen())
    if isinstance(model, E.TwoLevel):
        return model.predict(data.x, data.seen)
    return model.predict(data.x, data.hashes) if isinstance(model, E.Partition) else model.predict(data.x)


def _parts(model: Model, level: int) -> dict:
    """The mixtures of a level: of one level itself, of two the macro mixture and then those of its clusters."""
    if isinstance(model, (E.Diagonal, E.Latent)):
        return {None: model} if level == 0 else {}
    if level == 0:
        return {None: model.macro} if model.macro is not None else {}
    return dict(model.models)


def _part_rows(model: Model, part: int | None, data: Data) -> tuple[tuple, np.ndarray | None]:
    """What a part is learnt from, and which rows they are (all if None)."""
    if isinstance(model, E.Latent):
        return (data.views, data.view_seen), None
    if isinstance(model, E.Diagonal):
        return (data.x, data.columns_seen()), None
    if isinstance(model, E.Nested):
        if part is None:
            return (data.x, None), None
        own = np.flatnonzero(model.top(data.x) == part)
        return (data.x[own], None), own
    c = data.x[:, slice(*model.blocks[0])]
    if part is None:
        return (c, None), None
    own = np.flatnonzero(model.macro.predict(c) == part)
    seen = E.block_mask(data.seen, len(c), len(model.blocks))[own]
    features, there, blocks = model._micro(data.x[own], seen, part)
    return (features, np.repeat(there, [hi - lo for lo, hi in blocks], axis=1)), own


def columns_of(models: list[Model]) -> list[str]:
    """What a step of these models reads; with all columns, most of its time went into handing them to Python."""
    of = {E.Latent: ["_views", "_there"], E.Partition: ["_x"]}
    return [*dict.fromkeys(c for m in models for c in of.get(type(m), ["_x", "_seen"])), "_h"]


def over_rows(table: Table, work: list[Callable[[Data], np.ndarray]], most: bool = False, columns: list[str] | None = None) -> list[np.ndarray]:
    """The sum over all rows of each function of a batch, with some columns or all; with `most`, its greatest values."""
    ship(table.rows.sparkSession)
    blocks = table.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray | None] = [None] * len(work)
        for batch in batches:
            if not batch.num_rows:
                continue
            data = as_data({n: batch.column(n) for n in batch.schema.names}, blocks)
            for i, f in enumerate(work):
                got = f(data)
                total[i] = got if total[i] is None else np.maximum(total[i], got) if most else total[i] + got
        some = [i for i, t in enumerate(total) if t is not None]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[i].tolist() for i in some], pa.list_(pa.float64()))], ["fit", "sums"])

    each = (table.rows.select(*columns) if columns else table.rows).mapInArrow(run, "fit int, sums array<double>").select("fit", F.posexplode("sums").alias("at", "v"))
    found = each.groupBy("fit", "at").agg((F.max("v") if most else F.sum("v")).alias("v"))
    rows = found.toPandas()  # parameters of the fits
    out = [np.zeros(0)] * len(work)
    for i, own in rows.groupby("fit"):
        values = np.zeros(int(own["at"].max()) + 1)
        values[own["at"].to_numpy()] = own["v"].to_numpy()
        out[int(i)] = values
    return out


def polished(table: Table, models: list[Model], runs: list[int | None] | None = None, steps: int = 100, tolerance: float = 1e-3) -> list[Model]:
    """Mixtures that go on over the whole table until their likelihood settles; of two levels the macro one first."""
    runs = runs or [None] * len(models)
    models = [copy(m) for m in models]
    for level in (0, 1):
        live = {(i, part): m for i, model in enumerate(models) for part, m in _parts(model, level).items()}
        settled, before = {}, {}
        for _ in range(steps):
            if not live:
                break
            names = list(live)

            def work_of(i: int, part: int | None, own: E.Diagonal | E.Latent) -> Callable[[Data], np.ndarray]:
                owner, run = models[i], runs[i]

                def work(data: Data) -> np.ndarray:
                    args, rows = _part_rows(owner, part, data)
                    weight = None if run is None else replicate_weights(data.hashes if rows is None else data.hashes[rows], run)
                    return own.sums(*args, weight)

                return work

            for name, sums in zip(names, over_rows(table, [work_of(*n, live[n]) for n in names], columns=columns_of(models))):
                model = live[name]
                if not len(sums) or sums[0] <= 0:
                    settled[name] = live.pop(name)
                    continue
                bound = float(sums[1] / sums[0])
                if bound - before.get(name, -np.inf) < tolerance:
                    settled[name] = replace(live.pop(name), bound=bound, converged=True)
                else:
                    before[name], live[name] = bound, model.updated(sums)
        for (i, part), m in (settled | live).items():
            if isinstance(models[i], (E.Diagonal, E.Latent)):
                models[i] = m
            elif part is None:
                models[i].macro = m
            else:
                models[i].models = models[i].models | {part: m}
    return models


# ---------------------------------------------------------------- k-means of all rows


@dataclass
class Fits:
    """Fits of k centres, one a seed, of all rows or of a group's, by the first `axes` columns."""

    k: int
    seeds: list[int]
    axes: int
    group: int | None = None

    def of(self, data: Data) -> tuple[np.ndarray, np.ndarray]:
        """(features, hashes) of their rows."""
        if self.group is None:
            return data.x[:, : self.axes], data.hashes
        own = np.flatnonzero(data.groups == self.group)
        return data.x[own, : self.axes], data.hashes[own]


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, squared distance), each (row, fit), by centres (fit, region, axis); the lowest of equals."""
    label = np.zeros((len(x), len(centres)), np.int64)
    least = np.full(label.shape, np.inf)
    for j in range(centres.shape[1]):
        d = np.zeros(label.shape)
        for a in range(x.shape[1]):
            off = x[:, a, None] - centres[None, :, j, a]
            d += off * off
        closer = d < least
        label[closer] = j
        least = np.where(closer, d, least)
    return label, least


def _sums_by_label(label: np.ndarray, k: int, values: list[np.ndarray]) -> np.ndarray:
    """(fit, 1 + values, k): the rows of each label and the sums of their values."""
    fits = label.shape[1]
    at = (label + k * np.arange(fits)).ravel()
    sums = [np.bincount(at, minlength=fits * k), *(np.bincount(at, np.repeat(v, fits), fits * k) for v in values)]
    return np.stack([s.reshape(fits, k) for s in sums], 1).astype(float)


def first_rows(table: Table, work: list[Callable[[Data], tuple[np.ndarray, np.ndarray] | None]], columns: list[str]) -> list[np.ndarray]:
    """(fit, axis) for each function of a batch: it gives each of its fits a score and a row, and the row of the highest score wins."""
    ship(table.rows.sparkSession)
    blocks = table.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(work)
        for batch in batches:
            if not batch.num_rows:
                continue
            data = as_data({n: batch.column(n) for n in batch.schema.names}, blocks)
            for i, f in enumerate(work):
                got = f(data)
                if got is not None and best[i] is not None:
                    ahead = got[0] > best[i][0]
                    got = np.where(ahead, got[0], best[i][0]), np.where(ahead[:, None], got[1], best[i][1])
                best[i] = best[i] if got is None else got
        told = [(i, j, float(s), r.tolist()) for i, b in enumerate(best) if b is not None for j, (s, r) in enumerate(zip(*b))]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([t[c] for t in told], kind) for c, kind in enumerate(kinds)], ["work", "fit", "score", "row"])

    each = table.rows.select(*columns).mapInArrow(run, "work int, fit int, score double, row array<double>")
    found = each.groupBy("work", "fit").agg(F.max(F.struct("score", "row")).alias("m")).select("work", "fit", "m.row").collect()  # a row a fit
    out: list[dict[int, list[float]]] = [{} for _ in work]
    for r in found:
        out[r["work"]][r["fit"]] = r["row"]
    return [np.array([rows[j] for j in sorted(rows)]) for rows in out]


def spread_centres(table: Table, jobs: list[Fits]) -> list[np.ndarray]:
    """First centres (fit, region, axis) of jobs whose rows are there: rows, each next drawn in proportion to its squared distance
    from those before. A row's score is the logarithm of that and a Gumbel number of its hash."""
    chosen = [np.zeros((len(j.seeds), 0, j.axes)) for j in jobs]
    for step in range(max((j.k for j in jobs), default=0)):
        live = [i for i, j in enumerate(jobs) if j.k > step]

        def work_of(i: int) -> Callable[[Data], tuple[np.ndarray, np.ndarray] | None]:
            job, before, salts = jobs[i], chosen[i], [E.seed_of(s, step) for s in jobs[i].seeds]

            def work(data: Data) -> tuple[np.ndarray, np.ndarray] | None:
                x, hashes = job.of(data)
                if not len(x):
                    return None
                with np.errstate(divide="ignore"):
                    score = -np.log(-np.log(uniforms(hashes, salts) + 2.0**-54))
                    if step:
                        far = nearest_centres(x, before)[1]
                        score += np.where(far > 0, np.log(far), -1e6)  # a place that is taken comes last
                first = score.argmax(0)
                return score[first, np.arange(len(first))], x[first]

            return work

        for i, rows in zip(live, first_rows(table, [work_of(i) for i in live], _columns_of_fits(jobs))):
            chosen[i] = np.concatenate([chosen[i], rows[:, None, :]], 1)
    return chosen


def _columns_of_fits(jobs: list[Fits]) -> list[str]:
    return ["_x", "_h", *(["_g"] if any(j.group is not None for j in jobs) else [])]


def kmeans(table: Table, jobs: list[Fits], most: int = 300, tolerance: float = 1e-8) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centres (fit, region, axis), inertia of each fit) of jobs whose rows are there: estimators.kmeans() over the whole table,
    all starts of all jobs in one pass a step. An empty region begins anew at the row farthest from its centre, one of a fit a step."""
    centres, live = spread_centres(table, jobs), [np.ones(len(j.seeds), bool) for j in jobs]
    columns = _columns_of_fits(jobs)

    def step(which: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """(fit, inertia then 1 + axes sums of each region) of some fits."""

        def work_of(i: int, own: np.ndarray) -> Callable[[Data], np.ndarray]:
            job, at = jobs[i], centres[i][own]

            def work(data: Data) -> np.ndarray:
                x, _ = job.of(data)
                label, least = nearest_centres(x, at)
                return np.concatenate([least.sum(0)[:, None], _sums_by_label(label, job.k, list(x.T)).reshape(len(at), -1)], 1).ravel()

            return work

        return [got.reshape(len(own), -1) for (_, own), got in zip(which, over_rows(table, [work_of(i, own) for i, own in which], columns=columns))]

    def farthest(i: int, own: np.ndarray) -> np.ndarray:
        job, at = jobs[i], centres[i][own]

        def work(data: Data) -> tuple[np.ndarray, np.ndarray] | None:
            x, _ = job.of(data)
            if not len(x):
                return None
            least = nearest_centres(x, at)[1]
            first = least.argmax(0)
            return least[first, np.arange(len(first))], x[first]

        return first_rows(table, [work], columns)[0]

    for _ in range(most):
        which = [(i, np.flatnonzero(own)) for i, own in enumerate(live) if own.any()]
        if not which:
            break
        for (i, own), got in zip(which, step(which)):
            sums = got[:, 1:].reshape(len(own), 1 + jobs[i].axes, jobs[i].k)
            sizes = sums[:, 0, :, None]
            new = np.where(sizes > 0, np.moveaxis(sums[:, 1:], 1, 2) / np.maximum(sizes, 1), centres[i][own])
            bare = np.flatnonzero((sizes == 0).any((1, 2)))
            if len(bare):
                new[bare, (sizes[bare, :, 0] == 0).argmax(1)] = farthest(i, own[bare])
            moved = ((new - centres[i][own]) ** 2).sum((1, 2))
            centres[i][own] = new
            live[i][own[moved <= tolerance]] = False
    every = [(i, np.arange(len(j.seeds))) for i, j in enumerate(jobs)]
    return [(c, got[:, 0]) for c, got in zip(centres, step(every))] if jobs else []


# ---------------------------------------------------------------- regions of a minimum size


def priced(table: Table, models: list[E.Partition], least: int, rounds: int = 30, tolerance: float = 1e-9) -> list[E.Partition]:
    """Partitions of the whole table: centres of the rows they have, prices at which every region has `least` rows.

    A round is one pass for all partitions, and some more for those of which a region is too small."""
    models, live = [copy(m) for m in models], set(range(len(models)))
    for _ in range(max(1, rounds)):
        if not live:
            break
        for i, got in fit_prices(table, models, sorted(live), least).items():
            k, d = models[i].centres.shape
            sizes, sums = got[1 : 1 + k, None], got[1 + k :].reshape(k, d)
            centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), models[i].centres)
            moved = float(((centres - models[i].centres) ** 2).sum())
            models[i].inertia = float(got[0])
            if moved <= (max(tolerance, 1e3 * models[i].jitter) if models[i].prices.any() else tolerance):
                live.discard(i)
            else:  # prices begin anew: one that is no longer needed falls back to none
                models[i] = replace(models[i], centres=centres, prices=np.zeros(k))
    fit_prices(table, models, sorted(live), least)  # those that the rounds left in motion
    return models


def balanced(table: Table, jobs: list[Fits], least: int, most: int = 100) -> list[E.Partition]:
    """estimators.balanced() over the whole table: every start of every job goes on until its centres rest, and the one of least inertia wins."""
    axes = jobs[0].axes
    told = over_rows(table, [lambda d: np.concatenate([d.x.sum(0), (d.x**2).sum(0)])], columns=["_x", "_h"])[0].reshape(2, -1)[:, :axes] / max(table.size, 1)
    jitter = 1e-9 * max(float((told[1] - told[0] ** 2).sum()), 1e-12)
    begun = [(i, E.Partition(c, np.zeros(0, int), math.inf, None, jitter)) for i, centres in enumerate(spread_centres(table, jobs)) for c in centres]
    models = priced(table, [m for _, m in begun], least, most)
    return [min((m for (j, _), m in zip(begun, models) if j == i), key=lambda m: m.inertia) for i in range(len(jobs))]


def region_sums(table: Table, models: list[E.Partition], which: list[int]) -> dict[int, np.ndarray]:
    """Of some partitions the sum of squared distances, the rows of each region and the sums of their coordinates, in one pass."""

    def work_of(m: E.Partition) -> Callable[[Data], np.ndarray]:
        def work(data: Data) -> np.ndarray:
            labels, k = m.predict(data.x, data.hashes), len(m.centres)
            far = ((data.x - m.centres[labels]) ** 2).sum()
            sums = np.stack([np.bincount(labels, v, k) for v in data.x.T], 1)
            return np.concatenate([[far], np.bincount(labels, minlength=k), sums.ravel()])

        return work

    return dict(zip(which, over_rows(table, [work_of(models[i]) for i in which], columns=columns_of(models)))) if which else {}


def fit_prices(table: Table, models: list[E.Partition], which: list[int], least: int) -> dict[int, np.ndarray]:
    """Sets the prices of some partitions so that every region has `least` rows, as far as there are rows for all; their region_sums().

    What estimators.settling() asks for all of them is answered together: sizes in one pass, ranks of margins in a few.
    The pass that told the last sizes told the sums as well, so that regions without prices take one pass a round.
    """
    talks = {i: E.settling(models[i], min(least, table.size // len(models[i].centres)), least // 100) for i in which}
    answers: dict[int, object] = dict.fromkeys(talks)
    told: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # prices, and the sums by them
    while talks:
        asked = {}
        for i in list(talks):
            try:
                asked[i] = talks[i].send(answers[i])
            except StopIteration:
                del talks[i]
        for i, got in region_sums(table, models, [i for i, a in asked.items() if a[0] == "sizes"]).items():
            told[i] = models[i].prices.copy(), got
            answers[i] = got[1 : 1 + len(models[i].centres)].astype(int)
        answers |= margin_ranks(table, models, {i: a[1:] for i, a in asked.items() if a[0] == "ranks"})
    known = {i: got for i, (prices, got) in told.items() if np.array_equal(prices, models[i].prices)}
    return known | region_sums(table, models, [i for i in which if i not in known])


def margin_ranks(table: Table, models: list[E.Partition], asked: dict[int, tuple[list[int], list[tuple[int | None, int]]]]) -> dict[int, list[tuple[float, float]]]:
    """For each partition's questions the two ends between which the margin of a rank lies: counted in bins of growing width
    first, and then in ever finer ones of equal width, until a bin holds one row in 100,000 at most."""
    few = max(1, table.size // 100_000)
    ends = {(i, q): (0.0, math.inf) for i, (_, questions) in asked.items() for q in range(len(questions))}
    open_ = set(ends)
    for _ in range(NARROWED):
        if not open_:
            break
        order = sorted({i for i, _ in open_})
        edges = {n: _edges(*ends[n]) for n in open_}

        def work_of(i: int) -> Callable[[Data], np.ndarray]:
            model, (inside, questions) = models[i], asked[i]
            own_edges = [(q, questions[q][0], edges[i, q]) for q in range(len(questions)) if (i, q) in edges]

            def work(data: Data) -> np.ndarray:
                margin, region = model.margins(data.x, data.hashes, inside)
                counts = [np.bincount(np.searchsorted(e, margin if r is None else margin[region == r], side="left"), minlength=len(e) + 1) for _, r, e in own_edges]
                return np.concatenate(counts).astype(float)  # bin b has margins up to edge b

            return work

        for i, got in zip(order, over_rows(table, [work_of(i) for i in order], columns=columns_of(models))):
            at = 0
            for q in [q for q in range(len(asked[i][1])) if (i, q) in edges]:
                e, rank = edges[i, q], asked[i][1][q][1]
                counts = got[at : at + len(e) + 1] if len(got) else np.zeros(len(e) + 1)
                at += len(e) + 1
                reached = np.cumsum(counts)
                b = int(np.searchsorted(reached, rank))
                if b > len(e):  # fewer rows than that
                    ends[i, q] = (math.inf, math.inf)
                else:
                    ends[i, q] = (float(e[b - 1]) if b else 0.0, float(e[b]) if b < len(e) else math.inf)
                if b > len(e) or b == 0 or counts[b] <= few and b < len(e) or ends[i, q][1] <= ends[i, q][0] * (1 + 1e-15):
                    open_.discard((i, q))
    return {i: [ends[i, q] for q in range(len(questions))] for i, (_, questions) in asked.items()}


def _edges(lo: float, hi: float) -> np.ndarray:
    """Upper ends of bins: powers at first, equal steps between two ends."""
    if math.isinf(hi):
        return np.append(0.0, np.logspace(-18, 18, BINS)) if lo <= 0 else lo * np.logspace(0, 18, BINS)
    return lo + (hi - lo) * np.arange(0, BINS + 1) / BINS


# ---------------------------------------------------------------- labels and what they say


def labelled(table: Table, models: list[Model]) -> Table:
    """The table with `labels`, an array of every model's label, stored."""
    ship(table.rows.sparkSession)
    blocks = table.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = as_data({n: batch.column(n) for n in batch.schema.names}, blocks)
            found = np.stack([predicted(m, data) for m in models], 1).astype(np.int32) if batch.num_rows else np.zeros((0, len(models)), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(models), pa.int32()), pa.array(found.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "labels"])

    schema = ", ".join(f"{n} {t}" for n, t in table.rows.dtypes)
    return Table(stored(table.rows.mapInArrow(run, f"{schema}, labels array<int>"), "labelled"), table.blocks, table.size)


def cells(table: Table) -> dict[int, pd.DataFrame]:
    """By model (label, _pattern, _q, n): one aggregate of all labels."""
    each = table.rows.select("_pattern", "_q", F.posexplode("labels").alias("model", "label"))
    found = each.groupBy("model", "label", "_pattern", "_q").agg(F.count("*").alias("n")).toPandas()
    return {int(m): own for m, own in found.groupby("model")}


def agreement(table: Table, pairs: list[tuple[int, int]], sizes: list[int]) -> list[np.ndarray]:
    """The contingency table of each pair of models' labels, all from one aggregate over the whole table."""
    if not pairs:
        return []
    pair = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col("labels")[i].alias("a"), F.col("labels")[j].alias("b")) for p, (i, j) in enumerate(pairs))))
    found = table.rows.select(pair.alias("c")).groupBy("c.p", "c.a", "c.b").agg(F.count("*").alias("n")).collect()  # a row a cell
    out = [np.zeros((sizes[i], sizes[j])) for i, j in pairs]
    for r in found:
        out[r["p"]][r["a"], r["b"]] = r["n"]
    return out


def certainty(table: Table, models: list[E.Diagonal | E.Latent]) -> list[tuple[float, float, float]]:
    """(log likelihood, sum of p ln p, mean margin of the two largest shares) of each mixture over the whole table."""

    def work_of(model: E.Diagonal | E.Latent) -> Callable[[Data], np.ndarray]:
        def work(data: Data) -> np.ndarray:
            args, _ = _part_rows(model, None, data)
            share, total = E.shares_of(model.log_joint(*args))
            top = np.sort(share, axis=1)
            margin = top[:, -1] - top[:, -2] if share.shape[1] > 1 else np.ones(len(top))
            return np.array([total.sum(), (share * np.log(np.maximum(share, 1e-12))).sum(), margin.sum()])

        return work

    return [(float(s[0]), float(s[1]), float(s[2] / max(table.size, 1))) for s in over_rows(table, [work_of(m) for m in models], columns=columns_of(models))]


# ---------------------------------------------------------------- labels as column expressions


def best_component(model: E.Diagonal, values: list[Column], seen: list[Column] | None = None) -> Column:
    """The component of highest likelihood, the lowest of equals."""
    terms = []
    for i, (w, m, v) in enumerate(zip(model.weights, model.means, model.variances)):
        term = F.lit(float(np.log(max(w, 1e-300))))
        for j, c in enumerate(values):
            off = c - float(m[j])
            one = -0.5 * (float(np.log(2 * np.pi * v[j])) + off * off / float(v[j]))
            term = term + (one if seen is None else F.when(seen[j], one).otherwise(0.0))
        terms.append(F.struct(term.alias("v"), F.lit(-i).alias("i")))
    return (-F.array_max(F.array(*terms))["i"]).cast("int")


def best_hidden(model: E.Latent, views: list[list[Column]], seen: list[Column]) -> Column:
    """The component of highest likelihood of two views, either of which may be missing."""
    terms = []
    for i, w in enumerate(model.weights):
        total = F.lit(float(np.log(max(w, 1e-300))))
        for a in range(model.means.shape[1]):
            s, noise = float(model.spread[i, a]), [float(n[i, a]) for n in model.noise]
            off = [F.when(seen[v], views[v][a] - float(model.means[i, a] + model.bias[v, i, a])).otherwise(0.0) for v in (0, 1)]
            told = [F.when(seen[v], 1 / noise[v]).otherwise(0.0) for v in (0, 1)]
            fixed = sum((F.when(seen[v], float(np.log(2 * np.pi * noise[v]))).otherwise(0.0) for v in (0, 1)), F.lit(0.0))
            precision = 1 / s + told[0] + told[1]
            centre = told[0] * off[0] + told[1] * off[1]
            total = total - 0.5 * (fixed + told[0] * off[0] * off[0] + told[1] * off[1] * off[1] + F.log(s * precision) - centre * centre / precision)
        terms.append(F.struct(total.alias("v"), F.lit(-i).alias("i")))
    return (-F.array_max(F.array(*terms))["i"]).cast("int")


def label_column(model: Model, values: list[Column], seen: list[Column], blocks: E.Blocks, views: list[list[Column]], there: list[Column], hashed: Column) -> Column:
    """A model's label of a row, from its features, blocks seen, views, views there and hash; the same as predicted()."""
    if isinstance(model, E.Latent):
        return best_hidden(model, views, there)
    if isinstance(model, E.Diagonal):
        return best_component(model, values, [s for s, (lo, hi) in zip(seen, blocks) for _ in range(lo, hi)])
    if isinstance(model, E.Partition):
        place = F.pmod(hashed, F.lit(1 << 32)) / float(1 << 32)
        costs = []
        for j, c in enumerate(model.centres):
            d = sum(((v - float(m)) * (v - float(m)) for v, m in zip(values[1:], c[1:])), (values[0] - float(c[0])) * (values[0] - float(c[0])))
            x = place * float(E.JITTER[j % len(E.JITTER)] * (1 + j))
            costs.append(F.struct((d + (x - F.floor(x)) * float(model.jitter) - float(model.prices[j])).alias("d"), F.lit(j).alias("i")))
        return F.array_min(F.array(*costs))["i"].cast("int")
    if isinstance(model, E.Nested):
        top = best_component(model.macro, values) if model.macro is not None else F.lit(0)
        inner = {i: best_component(m, values) for i, m in model.models.items()}
    else:
        lo, hi = model.blocks[0]
        top = best_component(model.macro, values[lo:hi])
        inner = {i: best_component(m, *_micro_columns(model, i, values, seen)) for i, m in model.models.items()}
    out = F.lit(0)
    for i, first in model.first.items():
        out = F.when(top == i, first + inner[i] if i in inner else F.lit(first)).otherwise(out)
    return out.cast("int")


def _micro_columns(model: E.TwoLevel, macro: int, values: list[Column], seen: list[Column]) -> tuple[list[Column], list[Column]]:
    """What TwoLevel._micro() makes of rows, as columns."""
    (lo, hi), (tlo, thi) = model.blocks[:2]
    tension = values[tlo:thi]
    local = [c - float(m) for c, m in zip(values[lo:hi], model.centres[macro])]
    some = seen[0]
    for s in seen[1:]:
        some = some | s
    shown = [seen[0] | ~some, *seen[1:]]  # a row that shows no block shows the first
    if model.mode == "tension_only":
        return [model.tension_weight * c for c in tension], [F.lit(True)] * len(tension)
    if model.mode == "tension_plus_small_consensus":
        parts = [([model.tension_weight * c for c in tension], shown[1] | ~(shown[0] | shown[1])), ([model.consensus_weight * c for c in local], shown[0])]
    else:
        parts = [(tension, shown[1]), (local, shown[0])]
        if len(model.blocks) == 3:
            mlo, mhi = model.blocks[2]
            parts.insert(1, ([c - float(m) for c, m in zip(values[mlo:mhi], model.metadata[macro])], shown[2]))
        shows = parts[0][1]
        for _, s in parts[1:]:
            shows = shows | s
        parts[-1] = (parts[-1][0], parts[-1][1] | ~shows)
    return [c for cs, _ in parts for c in cs], [s for cs, s in parts for _ in cs]
