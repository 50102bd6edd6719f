"""Estimators whose data step is a Spark job and whose parameters, K x D numbers, live on the driver.

Each iteration is one aggregate over the table; rows never leave the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import estimators as E


def _square(columns: list[str], centre: list[float]) -> Column:
    out = F.lit(0.0)
    for c, m in zip(columns, centre):
        out = out + (F.col(c) - float(m)) * (F.col(c) - float(m))
    return out


def nearest_centre(columns: list[str], centres: list[list[float]]) -> Column:
    """Number of the nearest centre, the lowest of equals."""
    return F.array_min(F.array(*(F.struct(_square(columns, m).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(centres))))["i"]


def soft_assign(columns: list[str], centres: list[list[float]]) -> list[Column]:
    """softmax of minus the squared distances."""
    d = [_square(columns, m) for m in centres]
    low = F.least(*d) if len(d) > 1 else d[0]
    e = [F.exp(low - x) for x in d]
    return [x / sum(e[1:], e[0]) for x in e]


def start_centres(df: DataFrame, columns: list[str], k: int, seed: int, key: str) -> list[list[float]]:
    """k rows far apart: the first by a hash of the key, each next the farthest from those before."""
    first = df.orderBy(F.xxhash64(F.lit(seed), key), key).select(*columns).first()
    centres = [[float(x) for x in first]]
    while len(centres) < k:
        far = F.array_min(F.array(*(_square(columns, m) for m in centres)))
        row = df.select(*columns, key).orderBy(F.desc(far), key).first()
        centres.append([float(row[c]) for c in columns])
    return centres


@dataclass
class Regions:
    centres: list[list[float]]
    inertia: float
    labelled: DataFrame


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 0, key: str = "idx", most: int = 50, centres: list[list[float]] | None = None) -> Regions:
    """Lloyd's iterations from far-apart rows; an empty region keeps its centre."""
    centres = centres or start_centres(df, columns, k, seed, key)
    for _ in range(most):
        rows = df.withColumn("_l", nearest_centre(columns, centres)).groupBy("_l").agg(*(F.avg(c).alias(c) for c in columns)).collect()  # k rows
        new = [list(c) for c in centres]
        for r in rows:
            new[r["_l"]] = [float(r[c]) for c in columns]
        moved = max(abs(a - b) for x, y in zip(new, centres) for a, b in zip(x, y))
        centres = new
        if moved < 1e-9:
            break
    labelled = df.withColumn("region", nearest_centre(columns, centres))
    inertia = df.agg(F.sum(F.array_min(F.array(*(_square(columns, m) for m in centres)))).alias("s")).first()["s"]
    return Regions(centres, float(inertia or 0.0), labelled)


def balanced_regions(df: DataFrame, columns: list[str], k: int, least: int, key: str = "idx", starts: int = 10, most: int = 100, seed: int = 42, sample: int = 10_000) -> Regions:
    """k-means whose regions keep a minimum size in every iteration; the start of least inertia wins.

    Starts are tried on at most `sample` rows by a hash of the key (a documented bound; all rows of a smaller table), with
    the minimum in proportion. The best goes on over the whole table until its centres rest: prices of regions hold the sizes there."""
    from . import whole

    hashed = F.xxhash64(F.col(key).cast("string"))
    arrays = {"_seen": "array<boolean>", "_views": "array<double>", "_there": "array<boolean>", "_plane": "array<double>"}
    rows = df.select(F.col(key).cast("string").alias("_k"), F.array(*(F.col(c).cast("double") for c in columns)).alias("_x"), hashed.alias("_h"), *(F.array().cast(t).alias(n) for n, t in arrays.items()), F.lit(-1).alias("_q"), F.lit(-1).alias("_pattern"))
    rows = whole.dealt(rows)
    table = whole.Table(rows, None, rows.count())
    if table.size < k * least:
        raise ValueError(f"{table.size} rows can't give each of {k} regions {least}")
    some = table.sample(sample, seed)
    begun = E.balanced(some.x, k, max(1, -(-least * len(some.x) // table.size)), seed, starts, most, some.hashes)
    model = whole.priced(table, [begun], least, min(most, 30))[0]
    labelled = df.withColumn("region", whole.label_column(model, [F.col(c).cast("double") for c in columns], [], [], [], [], hashed))
    return Regions(model.centres.tolist(), float(model.inertia), labelled)


@dataclass
class Mixture:
    """Diagonal Gaussian mixture with blocks of columns that may be missing in a row."""

    columns: list[str]
    observed: dict[str, str]  # column to the boolean column that says whether it is there
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    bounds: list[float]

    def log_joint(self) -> list[Column]:
        out = []
        for w, m, v in zip(self.weights, self.means, self.variances):
            term = F.lit(math.log(max(float(w), 1e-300)))
            for c, mean, var in zip(self.columns, m, v):
                one = -0.5 * (math.log(2 * math.pi * float(var)) + (F.col(c) - float(mean)) * (F.col(c) - float(mean)) / float(var))
                term = term + (F.when(F.col(self.observed[c]), one).otherwise(0.0) if c in self.observed else one)
            out.append(term)
        return out

    def log_likelihood(self) -> Column:
        terms = self.log_joint()
        high = F.greatest(*terms) if len(terms) > 1 else terms[0]
        return high + F.log(sum((F.exp(t - high) for t in terms[1:]), F.exp(terms[0] - high)))

    def responsibilities(self) -> list[Column]:
        total = self.log_likelihood()
        return [F.exp(t - total) for t in self.log_joint()]

    def predict(self) -> Column:
        return F.array_max(F.array(*(F.struct(t.alias("v"), F.lit(-i).alias("i")) for i, t in enumerate(self.log_joint()))))["i"] * -1

    def parameters(self) -> int:
        k, d = self.means.shape
        return k * d * 2 + k - 1

    def bic(self, rows: int) -> float:
        return -2 * self.bounds[-1] * rows + self.parameters() * math.log(rows)


def gaussian_mixture(df: DataFrame, columns: list[str], k: int, observed: dict[str, str] | None = None, key: str = "idx", floor: float = 1e-4, most: int = 60, tolerance: float = 1e-5) -> Mixture:
    """Expectation maximisation: each step is one aggregate of K x D sums. A missing column adds nothing to any of them."""
    observed = observed or {}
    seen = {c: F.col(observed[c]) if c in observed else F.lit(True) for c in columns}
    filled = df.withColumns({c: F.when(seen[c], F.col(c)).otherwise(0.0) for c in observed}) if observed else df
    centres = kmeans(filled, columns, k, 0, key, most=10).centres
    spread = df.agg(*(F.var_pop(F.when(seen[c], F.col(c))).alias(c) for c in columns)).first()
    model = Mixture(columns, observed, np.full(k, 1 / k), np.array(centres), np.tile([max(float(spread[c] or 1.0), floor) for c in columns], (k, 1)), [])
    for _ in range(most):
        parts = df.withColumn("_r", F.array(*model.responsibilities())).withColumn("_ll", model.log_likelihood())
        sums = [F.avg("_ll").alias("ll"), F.count("*").alias("n")]
        for i in range(k):
            sums.append(F.sum(F.col("_r")[i]).alias(f"r{i}"))
            for j, c in enumerate(columns):
                weight = F.when(seen[c], F.col("_r")[i]).otherwise(0.0)
                value = F.when(seen[c], F.col(c)).otherwise(0.0)
                sums += [F.sum(weight).alias(f"w{i}_{j}"), F.sum(weight * value).alias(f"x{i}_{j}"), F.sum(weight * value * value).alias(f"y{i}_{j}")]
        s = parts.agg(*sums).first()
        model.bounds.append(float(s["ll"]))
        if len(model.bounds) > 1 and abs(model.bounds[-1] - model.bounds[-2]) < tolerance:
            break
        for i in range(k):
            model.weights[i] = max(float(s[f"r{i}"]), 1e-9) / s["n"]
            for j in range(len(columns)):
                w = max(float(s[f"w{i}_{j}"]), 1e-9)
                mean = float(s[f"x{i}_{j}"]) / w
                model.means[i, j] = mean
                model.variances[i, j] = max(float(s[f"y{i}_{j}"]) / w - mean * mean, floor)
        model.weights = model.weights / model.weights.sum()
    return model


def hungarian(cost: np.ndarray) -> list[int]:
    """The column of each row in a least-cost one-to-one assignment of a small matrix (rows <= columns)."""
    n, m = cost.shape
    u, v, way_of, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while of[j]:
            used[j] = True
            row, delta, following = of[j], np.inf, 0
            for c in range(1, m + 1):
                if not used[c]:
                    value = cost[row - 1, c - 1] - u[row] - v[c]
                    if value < least[c]:
                        least[c], way_of[c] = value, j
                    if least[c] < delta:
                        delta, following = least[c], c
            for c in range(m + 1):
                if used[c]:
                    u[of[c]] += delta
                    v[c] -= delta
                else:
                    least[c] -= delta
            j = following
        while j:
            of[j], j = of[way_of[j]], way_of[j]
    out = [0] * n
    for c in range(1, m + 1):
        if of[c]:
            out[of[c] - 1] = c - 1
    return out


def search_regions(df: DataFrame, columns: list[str], ks: range, least: int, key: str = "idx") -> DataFrame:
    """A row a K: score, silhouette, size balance, stability over reseeded starts, separation, purity, eligibility."""
    from .grid import nearest
    from .neighbors import purity_among, silhouette
    from .selection import region_score
    from .statistics import adjusted_rand, separation

    rows = []
    around = stored(nearest(df, df, columns, 20, key).select(key, "neighbour", "place"), "neighbours")  # the same for every K
    for k in ks:
        base = kmeans(df, columns, k, 0, key)
        labelled = stored(base.labelled, "labelled")
        sil = silhouette(labelled, columns, "region", key).agg(F.avg("silhouette").alias("m"), F.avg((F.col("silhouette") < 0).cast("double")).alias("n")).first()
        again = kmeans(df, columns, k, 1, key).labelled.select(key, F.col("region").alias("other"))
        ari = adjusted_rand(labelled.join(again, key), "region", "other").first()["ari"]
        sizes = [r["count"] for r in labelled.groupBy("region").count().collect()]  # k rows
        apart = separation(labelled, columns[0], columns[1], "region").first()["separation"]
        pure = purity_among(around, labelled, "region", 20, key).first()["purity"]
        rows.append((k, float(sil["m"]), float(sil["n"]), float(ari), min(sizes) / max(sizes), float(apart or 0.0), float(pure), min(sizes) >= least and len(sizes) == k, base.inertia))
    out = df.sparkSession.createDataFrame(rows, "k int, silhouette double, negative double, ari double, balance double, separation double, purity double, eligible boolean, inertia double")
    score = region_score(F.col("silhouette"), F.col("ari"), F.col("balance"), F.col("purity"), F.col("separation"), F.col("negative"))
    return out.withColumn("score", score)
