"""Spectral clustering by landmarks: rows as mixtures of their nearest landmarks, and the directions along which these go together.

A row is a weighted mean of its NEAR nearest landmarks, so that two rows are alike as far as they share some. The affinity of
all rows is then a product of two thin matrices, and its leading eigenvectors follow from the landmarks' own L x L matrix, two
aggregates over the table: the landmarks' mass, and how often two of them stand together. The rest is one projection of each
row and k-means of those. Landmarks are the centres of a documented sample; every row is embedded and labelled.

Rows with a coordinate that is null or not finite have the label -1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from ..sources.tables import stored
from . import estimators as E
from . import whole

LANDMARKS = 256
NEAR = 5
SAMPLE = 10_000


@dataclass
class Landmarks:
    """Places, how far apart they count as near, and the embedding's weights of each."""

    places: np.ndarray
    width: float
    weights: np.ndarray | None = None  # (landmark, direction)

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(landmark, share) of the nearest landmarks of each row; shares of a row add up to 1."""
        d = E.squared(x, self.places)
        near = np.argpartition(d, min(NEAR, len(self.places)) - 1, axis=1)[:, :NEAR]
        far = np.take_along_axis(d, near, 1)
        share = np.exp(-(far - far.min(1, keepdims=True)) / (2 * self.width))
        return near, share / share.sum(1, keepdims=True)

    def dense(self, x: np.ndarray) -> np.ndarray:
        near, share = self.shares(x)
        out = np.zeros((len(x), len(self.places)))
        np.put_along_axis(out, near, share, 1)
        return out

    def embedded(self, x: np.ndarray) -> np.ndarray:
        """Rows along the directions, of length 1."""
        near, share = self.shares(x)
        out = np.einsum("nl,nld->nd", share, self.weights[near])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def landmarks(sample: np.ndarray, many: int = LANDMARKS, seed: int = 42) -> Landmarks:
    """Centres of the sample's distinct places, and the mean squared distance of a place to its NEAR-th landmark."""
    distinct = np.unique(sample, axis=0)
    places = distinct if len(distinct) <= many else E.kmeans(distinct, many, seed, 1, 20).centres
    far = np.sort(E.squared(sample, places), axis=1)[:, min(NEAR, len(places)) - 1]
    return Landmarks(places, max(float(far.mean()), 1e-12))


def directions(table: whole.Table, marks: Landmarks, k: int) -> Landmarks:
    """The landmarks with the weights of the k leading directions of the whole table's affinity."""
    mass = whole.over_rows(table, [lambda data: marks.dense(data.x).sum(0)])[0]
    scale = 1 / np.sqrt(np.maximum(mass, 1e-12))

    def together(data: whole.Data) -> np.ndarray:
        z = marks.dense(data.x) * scale
        return (z.T @ z).ravel()

    many = len(marks.places)
    squares, turn = np.linalg.eigh(whole.over_rows(table, [together])[0].reshape(many, many))
    order = np.argsort(-squares)[:k]
    return Landmarks(marks.places, marks.width, scale[:, None] * turn[:, order] / np.sqrt(np.maximum(squares[order], 1e-12)))


def spectral_regions(df: DataFrame, columns: list[str], k: int, key: str = "idx", many: int = LANDMARKS, sample: int = SAMPLE, seed: int = 42, label: str = "cluster_id") -> DataFrame:
    """df with the label of each row; landmarks and the start of k-means are learnt on at most `sample` rows by a hash of the key."""
    numbers = F.array(*(F.col(c).cast("double") for c in columns))
    told = F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    arrays = {"_seen": "array<boolean>", "_views": "array<double>", "_there": "array<boolean>", "_plane": "array<double>"}
    base = [F.col(key).cast("string").alias("_k"), F.xxhash64(F.col(key).cast("string")).alias("_h"), *(F.array().cast(t).alias(n) for n, t in arrays.items()), F.lit(-1).alias("_q"), F.lit(-1).alias("_pattern")]
    rows = whole.dealt(df.filter(told).select(*base, numbers.alias("_x")))
    table = whole.Table(rows, None, rows.count())
    if not table.size:
        return df.withColumn(label, F.lit(-1))
    marks = directions(table, landmarks(table.sample(sample, seed).x, many, seed), min(k, many))
    wide = marks.weights.shape[1]
    ship(df.sparkSession)

    def embed(column: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                ok = np.isfinite(x).all(1) if x.size else np.zeros(batch.num_rows, bool)
                found = np.zeros((batch.num_rows, wide))
                if ok.any():
                    found[ok] = marks.embedded(x[ok])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * wide, pa.int32()), pa.array(found.ravel()))
                at = batch.schema.get_field_index(column)
                yield batch.set_column(at, pa.field(column, lists.type), lists)

        return run

    embedded = whole.Table(stored(rows.mapInArrow(embed("_x"), rows.schema), "embedded"), None, table.size)
    some = embedded.sample(sample, seed)
    model = whole.priced(embedded, [E.kmeans(some.x, k, seed, 10)], 0)[0]
    given = T.StructType([*df.schema.fields, T.StructField("_e", T.ArrayType(T.DoubleType())), T.StructField("_ok", T.BooleanType())])
    out = df.withColumns({"_e": numbers, "_ok": F.coalesce(told, F.lit(False))}).mapInArrow(embed("_e"), given)
    number = whole.label_column(model, [F.col("_e")[i] for i in range(wide)], [], [], [], [], F.xxhash64(F.col(key).cast("string")))
    return out.withColumn(label, F.when(F.col("_ok"), number).otherwise(-1)).drop("_e", "_ok")
