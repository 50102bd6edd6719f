"""Metadata as sparse rows: token blocks by field, weighted and scaled to length 1, numeric blocks, and their truncated SVD.

Features are long-form (key, feature, value), named field::token, so that a wide vocabulary costs what a row has. The SVD
meets the matrix a few times, never a square of its width: each pass sends some columns through all rows (A'A Q), tasks add up
their part, and one aggregate makes the next columns. Parameters, width x components numbers, are on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_list
from ..runtime import ship
from ..sources.tables import stored
from .features import numeric_block, vocabulary

REPRESENTATIONS = ("binary", "tfidf", "tfidf_svd")
MOST_TOKENS = 512
MOST_WIDTH = 1 << 17  # width of a matrix whose SVD is made: its columns are numbers of the driver
SPARE = 10  # columns beyond the components that a range is sought with
PASSES = 8


@dataclass
class Block:
    """Sparse rows (key, feature, value), their vocabulary (field, token, feature, frequency, column, weight), and per key has_any and completeness."""

    entries: DataFrame
    features: DataFrame
    coverage: DataFrame


def token_blocks(df: DataFrame, key: str, fields: Mapping[str, str | Column], weights: Mapping[str, float] | None = None, most: int = MOST_TOKENS, least: int = 1, representation: str = "tfidf", separators: str = ",") -> Block:
    """One block of tokens a field: the `most` tokens of highest document frequency, ties by token.

    binary: 1 for a token that a row has. tfidf: the token's smooth inverse document frequency over all rows of df times its
    field's weight, a row over all fields being of length 1; a row without tokens, or of weights that are 0, has no entries.
    """
    if representation not in ("binary", "tfidf"):
        raise ValueError("token blocks are binary or tfidf")
    weights = weights or {}
    parts, vocab = None, None
    for field, text in fields.items():
        tokens = token_list(F.col(text) if isinstance(text, str) else text, separators)
        rows = df.select(F.col(key), F.explode(F.array_distinct(tokens)).alias("token")).withColumn("field", F.lit(field))
        own = vocabulary(rows.select(key, "token"), key, most, least).select(F.lit(field).alias("field"), "token", "frequency", "place")
        parts, vocab = (rows if parts is None else parts.unionByName(rows)), (own if vocab is None else vocab.unionByName(own))
    order = {f: i for i, f in enumerate(fields)}
    at = F.element_at(F.create_map(*(x for f, i in order.items() for x in (F.lit(f), F.lit(i)))), F.col("field"))
    weight = F.element_at(F.create_map(*(x for f in fields for x in (F.lit(f), F.lit(float(weights.get(f, 1.0)))))), F.col("field"))
    column = F.row_number().over(Window.orderBy(at, "place")) - 1  # a row a token of a capped vocabulary
    vocab = stored(vocab.select("field", "token", F.concat_ws("::", "field", "token").alias("feature"), "frequency", column.alias("column"), weight.alias("weight")), "vocabulary")
    total = df.agg(F.count("*").alias("n"))  # one row
    met = parts.join(F.broadcast(vocab), ["field", "token"])  # at most `most` rows a field
    if representation == "tfidf":
        idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("frequency"))) + 1.0
        met = met.crossJoin(F.broadcast(total)).withColumn("value", idf * F.col("weight"))
        length = met.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
        met = met.join(length, key).withColumn("value", F.col("value") / F.greatest("length", F.lit(1e-12)))
        met = met.filter("value <> 0")
    else:
        met = met.withColumn("value", F.lit(1.0))
    known = parts.join(F.broadcast(vocab.select("field", "token")), ["field", "token"], "left_semi").select(key, "field").distinct().groupBy(key).agg(F.count("*").alias("shown"))
    some = parts.select(key).distinct().withColumn("any", F.lit(True))
    coverage = df.select(key).join(some, key, "left").join(known, key, "left")
    coverage = coverage.select(key, F.coalesce("any", F.lit(False)).alias("has_any"), (F.coalesce("shown", F.lit(0)) / float(max(len(fields), 1))).alias("completeness"))
    return Block(met.select(key, "feature", "column", "value"), vocab, coverage)


def features_with_numbers(df: DataFrame, key: str, fields: Mapping[str, str | Column], numbers: list[str], **more) -> DataFrame:
    """(key, feature, value) of the token blocks and of the numeric block, whose features have the columns' names."""
    block = token_blocks(df, key, fields, **more)
    imputed = numeric_block(df, numbers)
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_num").cast("double").alias("value")) for c in numbers)))
    return block.entries.select(key, "feature", "value").unionByName(imputed.select(key, told.alias("f")).select(key, "f.*"))


@dataclass
class Reduction:
    """Components of a sparse matrix: width x components, and how long the matrix is along each."""

    components: np.ndarray
    singular: np.ndarray

    def apply(self, packed: DataFrame, key: str, to: int, prefix: str = "metadata_svd") -> DataFrame:
        """(key, prefix_000, ...): rows along the components, filled up with zeros to `to` columns."""
        basis, types = self.components, dict(packed.dtypes)
        names = [f"{prefix}_{i:03d}" for i in range(to)]
        schema = f"{key} {types[key]}, " + ", ".join(f"{n} double" for n in names)
        ship(packed.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.zeros((batch.num_rows, to))
                found[:, : basis.shape[1]] = _times(batch, basis)
                yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(found[:, i]) for i in range(to))], [key, *names])

        return packed.select(key, "columns", "values").mapInArrow(run, schema)


def packed_rows(df: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """(key, columns, values): a row a key of df, empty arrays for one without entries."""
    rows = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("e"))  # as many as the vocabulary at most
    out = df.select(key).join(rows, key, "left")
    return out.select(key, *(F.coalesce(F.transform("e", lambda x: x[c].cast(t)), F.array().cast(f"array<{t}>")).alias(n) for c, n, t in (("column", "columns", "int"), ("value", "values", "double"))))


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    columns = batch.column("columns")
    counts = np.asarray(columns.value_lengths())
    return np.repeat(np.arange(batch.num_rows), counts), np.asarray(columns.flatten()), np.asarray(batch.column("values").flatten())


def _times(batch: pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
    """The sparse rows times a matrix."""
    row, column, value = _lists(batch)
    out = np.zeros((batch.num_rows, matrix.shape[1]))
    for i in range(matrix.shape[1]):
        out[:, i] = np.bincount(row, value * matrix[column, i], batch.num_rows)
    return out


def _gram_times(packed: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """A'A times a matrix in one pass over the rows of A."""
    width, many = matrix.shape
    ship(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, many))
        for batch in batches:
            row, column, value = _lists(batch)
            seen = _times(batch, matrix)
            for i in range(many):
                total[:, i] += np.bincount(column, value * seen[row, i], width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], ["at", "v"])

    found = packed.select("columns", "values").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # numbers of the components
    out = np.zeros(width * many)
    out[found["at"].to_numpy(int)] = found["v"].to_numpy(float)
    return out.reshape(width, many)


def truncated_svd(packed: DataFrame, width: int, components: int, seed: int = 42, passes: int = PASSES) -> Reduction:
    """The components along which the rows are longest, by a randomised range and a few passes; the largest weight of each is positive."""
    if width > MOST_WIDTH:
        raise ValueError(f"{width} columns: cap the vocabulary at {MOST_WIDTH}")
    components = max(1, min(components, width))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, components + SPARE))))[0]
    for _ in range(passes - 1):
        basis = np.linalg.qr(_gram_times(packed, basis))[0]
    squares, turn = np.linalg.eigh(basis.T @ _gram_times(packed, basis))
    order = np.argsort(-squares)[:components]
    found = basis @ turn[:, order]
    sign = np.sign(found[np.abs(found).argmax(0), np.arange(len(order))])
    return Reduction(found * np.where(sign == 0, 1, sign), np.sqrt(np.maximum(squares[order], 0)))


def represented(df: DataFrame, key: str, fields: Mapping[str, str | Column], representation: str = "tfidf_svd", to: int = 32, **more) -> tuple[DataFrame, Block, Reduction | None]:
    """(rows, block, reduction) of metadata: long-form entries for binary and tfidf, (key, metadata_svd_000, ...) for tfidf_svd.

    A vocabulary that is no wider than the components is taken as it is, filled up with zeros."""
    if representation not in REPRESENTATIONS:
        raise ValueError(f"a representation is one of {', '.join(REPRESENTATIONS)}")
    block = token_blocks(df, key, fields, representation="binary" if representation == "binary" else "tfidf", **more)
    if representation != "tfidf_svd":
        return block.entries, block, None
    packed = stored(packed_rows(df, key, block.entries), "sparse")
    width, rows = block.features.count(), df.count()
    components = max(1, min(to, rows, width))
    if components < width:
        reduction = truncated_svd(packed, width, components)
    else:
        reduction = Reduction(np.eye(max(width, 1))[:, :components], np.ones(components))
    return reduction.apply(packed, key, to), block, reduction
