"""What nearest neighbours tell of rows (means, purity, residuals), and silhouettes.

Neighbours come from grid.nearest(): exact, in work that grows as the rows. A silhouette is of means of all distances; on a
plane they come from distances.mean_distances(). With more columns it is quadratic: both sides are packed into blocks of some
BLOCK rows, a task meets one block of each and passes on sums, and evaluation_sample() is the documented bound of the metrics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from ..sources.tables import stored
from .distances import mean_distances
from .grid import nearest

BLOCK = 1024


def _packed(df: DataFrame, key: str, columns: list[str], carry: list[str], name: str) -> DataFrame:
    """One row a block: its keys, coordinates and carried values as arrays in one order."""
    total = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("_n"))
    blocked = df.select(key, *columns, *carry).crossJoin(F.broadcast(total)).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_n")))
    row = F.struct(F.col(key).alias("k"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    rows = blocked.groupBy("_b").agg(F.collect_list(row).alias("r"))
    fields = ["k", *(f"x{i}" for i in range(len(columns))), *(f"c{i}" for i in range(len(carry)))]
    return rows.select(*(F.col(f"r.{f}").alias(f"{name}_{f}") for f in fields))


def label_purity(df: DataFrame, columns: list[str], label: str, k: int, key: str = "idx") -> DataFrame:
    """One row: the mean share of a row's k nearest others that have its label."""
    return label_purities(df, columns, label, [k], key).withColumnRenamed(f"purity_{k}", "purity")


def label_purities(df: DataFrame, columns: list[str], label: str, ks: list[int], key: str = "idx") -> DataFrame:
    """One row with label_purity() of each k as purity_<k>, from one search."""
    found = nearest(df, df, columns, max(ks), key, carry=[label]).select(key, "place", F.col(label).alias("_other"))
    return _shares(found.join(df.select(key, label), key), label, ks, key)


def _shares(met: DataFrame, label: str, ks: list[int], key: str) -> DataFrame:
    same = (F.col("_other") == F.col(label)).cast("double")
    each = met.groupBy(key).agg(*(F.avg(F.when(F.col("place") <= k, same)).alias(f"purity_{k}") for k in ks))
    return each.agg(*(F.avg(f"purity_{k}").alias(f"purity_{k}") for k in ks))


def purity_among(found: DataFrame, labelled: DataFrame, label: str, k: int, key: str = "idx") -> DataFrame:
    """label_purity() by neighbours that are known already: found is (key, neighbour, place) of nearest()."""
    others = labelled.select(F.col(key).alias("neighbour"), F.col(label).alias("_other"))
    met = found.join(others, "neighbour").join(labelled.select(key, label), key)
    return _shares(met, label, [k], key).withColumnRenamed(f"purity_{k}", "purity")


def neighbour_means(left: DataFrame, right: DataFrame, columns: list[str], values: list[str], k: int, key: str = "idx", exclude_self: bool = False) -> DataFrame:
    """(key, means): means of values over each left row's k nearest right rows."""
    found = nearest(left, right, columns, k, key, exclude_self, carry=values)
    return found.groupBy(key).agg(*(F.avg(v).alias(v) for v in values))


def impute_unobserved(df: DataFrame, columns: list[str], values: list[str], observed: str, k: int = 5, key: str = "idx") -> DataFrame:
    """values of unobserved rows from their k nearest observed rows; observed rows are unchanged."""
    filled = neighbour_means(df.filter(~F.col(observed)), df.filter(F.col(observed)), columns, values, k, key)
    out = df.join(filled.select(key, *(F.col(v).alias(f"_{v}") for v in values)), key, "left")
    return out.withColumns({v: F.when(F.col(observed), F.col(v)).otherwise(F.col(f"_{v}")) for v in values}).drop(*(f"_{v}" for v in values))


def impute_from(df: DataFrame, reference: DataFrame, columns: list[str], values: list[str], observed: str, k: int = 5, key: str = "idx") -> DataFrame:
    """impute_unobserved() with the observed rows of another table, so that what was learnt there serves later tables."""
    filled = neighbour_means(df.filter(~F.col(observed)), reference.filter(F.col(observed)), columns, values, k, key)
    out = df.join(filled.select(key, *(F.col(v).alias(f"_{v}") for v in values)), key, "left")
    return out.withColumns({v: F.when(F.col(observed), F.col(v)).otherwise(F.coalesce(f"_{v}", F.lit(0.0))) for v in values}).drop(*(f"_{v}" for v in values))


def evaluation_sample(df: DataFrame, key: str = "idx", limit: int = 10_000, above: int = 20_000, seed: int = 42) -> DataFrame:
    """All rows up to `above`, else `limit` of them by a hash of the key: the documented sample of metrics on pairs of rows."""
    if df.count() <= above:
        return df
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(limit)


def sampled_silhouette(df: DataFrame, columns: list[str], label: str, key: str = "idx", mode: str = "auto", limit: int = 10_000, above: int = 20_000) -> DataFrame:
    """One row: mean silhouette and share below 0; over all rows (full), or evaluation_sample() (auto, sampled). Null with fewer than two labels."""
    if mode not in ("full", "auto", "sampled"):
        raise ValueError("a silhouette is full, auto or sampled")
    rows = df if mode == "full" else evaluation_sample(df, key, limit, above if mode == "auto" else limit)
    each = silhouette(rows, columns, label, key)
    several = F.countDistinct(label) > 1
    return each.agg(F.when(several, F.avg("silhouette")).alias("silhouette"), F.when(several, F.avg((F.col("silhouette") < 0).cast("double"))).alias("negative"))


def residual(df: DataFrame, columns: list[str], values: list[str], observed: str, k: int = 101, key: str = "idx") -> DataFrame:
    """values less their mean over the k nearest observed rows, the row itself included; unobserved rows are 0."""
    seen = df.filter(F.col(observed))
    means = neighbour_means(seen, seen, columns, values, k, key).select(key, *(F.col(v).alias(f"_{v}") for v in values))
    out = df.join(means, key, "left")
    return out.withColumns({f"{v}_residual": F.when(F.col(observed), F.col(v) - F.col(f"_{v}")).otherwise(0.0) for v in values}).drop(*(f"_{v}" for v in values))


def silhouette(df: DataFrame, columns: list[str], label: str, key: str = "idx") -> DataFrame:
    """(key, label, silhouette): Euclidean; a row alone in its label has 0, and so has every row of one label.

    On planes sums of distances come from distances.mean_distances(), to some 1e-11; what it doesn't take (more columns,
    coordinates that are no finite numbers, null labels) goes pair by pair.
    """
    if len(columns) == 2:
        df = stored(df.select(key, *columns, label), "labelled")  # places are joined by their coordinates
        odd = F.col(label).isNull()
        for c in columns:
            odd = odd | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
        told = df.agg(F.count("*").alias("n"), F.count_if(odd).alias("odd")).first()
        if told["n"] and not told["odd"]:
            each = mean_distances(df, columns, label)
            own = df.select(key, label, *((F.col(c).cast("double") + 0.0).alias(f"_x{i}") for i, c in enumerate(columns)))
            return own.join(each, ["_x0", "_x1", label]).select(key, label, _silhouette().alias("silhouette"))
    return _silhouette_by_pairs(df, columns, label, key)


def _silhouette() -> Column:
    a, b = F.col("a"), F.col("b")
    return F.when(a.isNull() | b.isNull() | (F.greatest(a, b) <= 0), 0.0).otherwise((b - a) / F.greatest(a, b))


def _silhouette_by_pairs(df: DataFrame, columns: list[str], label: str, key: str) -> DataFrame:
    """A task meets a block of rows and a block of points and passes on sums of distances by row and label."""
    ship(df.sparkSession)
    width, types = len(columns), dict(df.dtypes)
    schema = f"{key} {types[key]}, other {types[label]}, total double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                own, labels = np.asarray(row["l_k"]), np.asarray(row["r_c0"])
                x, y = (np.stack([np.asarray(row[f"{s}_x{i}"], float) for i in range(width)], 1) for s in "lr")
                for lo in range(0, len(own), 256):
                    d = np.sqrt(((x[lo : lo + 256, None, :] - y[None, :, :]) ** 2).sum(2))
                    for c in np.unique(labels):
                        yield pd.DataFrame({key: own[lo : lo + 256], "other": c, "total": d[:, labels == c].sum(1)})

    pairs = _packed(df, key, columns, [], "l").crossJoin(_packed(df, key, columns, [label], "r"))
    sums = pairs.mapInPandas(run, schema).groupBy(key, "other").agg(F.sum("total").alias("total"))
    sizes = df.groupBy(F.col(label).alias("other")).agg(F.count("*").alias("size"))
    met = sums.join(F.broadcast(sizes), "other").join(df.select(key, label), key)  # one row a label
    inner = F.col("other") == F.col(label)
    a = F.max(F.when(inner & (F.col("size") > 1), F.col("total") / (F.col("size") - 1)))
    b = F.min(F.when(~inner, F.col("total") / F.col("size")))
    each = met.groupBy(key, label).agg(a.alias("a"), b.alias("b"))
    return each.select(key, label, _silhouette().alias("silhouette"))
