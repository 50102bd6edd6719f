"""Datasets by split: rows of a split, checked and scaled views, and batches for training outside of Spark."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ["train", "val", "test"]


def split_rows(df: DataFrame, splits: DataFrame, split: str, key: str = "idx") -> DataFrame:
    """Rows of df whose position is in a split (split, key); `all` is every row."""
    if split == "all":
        return df
    if split not in SPLITS:
        raise ValueError(f"{split} is none of {[*SPLITS, 'all']}")
    return df.join(splits.filter(F.col("split") == split).select(key).distinct(), key, "left_semi")


def both_views(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that have both views, one row with kept and dropped counts)."""
    both = F.col("has_audio") & F.col("has_lyrics")
    return df.filter(both), df.agg(F.count_if(both).alias("kept"), F.count_if(~both).alias("dropped"))


def assemble(df: DataFrame, splits: DataFrame, split: str, views: dict[str, tuple[Sequence[str], str]], key: str = "idx", complete: bool = False, fit: str = "train") -> DataFrame:
    """A split's rows with z-scores of each view's columns, learnt from observed rows of the split `fit`; masked values are 0.

    views: {name: (columns, mask column)}; with `complete` only rows with both views are taken, for fitting too.
    """
    source = both_views(df)[0] if complete else df
    learnt, rows = split_rows(source, splits, fit, key), split_rows(source, splits, split, key)
    for columns, mask in views.values():
        stats = learnt.agg(*(f for c in columns for f in (F.avg(F.when(F.col(mask), F.col(c))).alias(f"{c}_m"), F.stddev_pop(F.when(F.col(mask), F.col(c))).alias(f"{c}_s"))))
        rows = rows.crossJoin(F.broadcast(stats))  # one row
        sd = {c: F.when(F.coalesce(F.col(f"{c}_s"), F.lit(0.0)) < 1e-6, 1.0).otherwise(F.col(f"{c}_s")) for c in columns}
        rows = rows.withColumns({f"{c}_z": F.when(F.col(mask), (F.col(c) - F.coalesce(f"{c}_m", F.lit(0.0))) / sd[c]).otherwise(0.0) for c in columns})
        rows = rows.withColumns({c: F.when(F.col(mask), F.col(c)).otherwise(0.0) for c in columns}).drop(*(f"{c}_{x}" for c in columns for x in "ms"))
    return rows


def all_splits(df: DataFrame, splits: DataFrame, views: dict[str, tuple[Sequence[str], str]], key: str = "idx") -> dict[str, DataFrame]:
    """Train, val and test of one dataset, scaled alike."""
    return {s: assemble(df, splits, s, views, key) for s in SPLITS}


def batches(df: DataFrame, columns: Sequence[str], size: int = 256, seed: int | None = None) -> Iterator[pd.DataFrame]:
    """Rows as pandas frames of one partition's rows at a time, in key or (with a seed) in hash order; the driver holds one batch."""
    rows = df.select(*columns)
    if seed is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), *columns))
    held: list = []
    for row in rows.toLocalIterator():
        held.append(tuple(row))
        if len(held) == size:
            yield pd.DataFrame(held, columns=list(columns))
            held = []
    if held:
        yield pd.DataFrame(held, columns=list(columns))


def checked(df: DataFrame, rows: int) -> DataFrame:
    """df, or ValueError where it has another number of rows than expected."""
    if (found := df.count()) != rows:
        raise ValueError(f"{found} rows where {rows} are expected")
    return df


def plane_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or ValueError unless the columns are two numbers of it."""
    kinds = dict(df.dtypes)
    if len(columns) != 2 or any(kinds.get(c) not in ("double", "float", "int", "bigint") for c in columns):
        raise ValueError(f"{list(columns)} is no pair of numeric columns")
    return df


def seeded(seed: int) -> np.random.Generator:
    """Seeds the generators of Python and NumPy and returns one of its own."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    return np.random.default_rng(seed)


def group_weights(text: str | None, defaults: dict[str, float]) -> dict[str, float]:
    """"k=v,k=v" over the defaults; an unknown group, or a value that is no number of 0 or more, is a ValueError."""
    out = dict(defaults)
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        name, _, value = (x.strip() for x in part.partition("="))
        if name not in defaults:
            raise ValueError(f"{name} is none of {sorted(defaults)}")
        out[name] = float(value)
        if not out[name] >= 0 or out[name] == float("inf"):
            raise ValueError(f"the weight of {name} is {value}")
    return out


def view_names(text: str, known: Sequence[str] = ("audio", "lyrics", "metadata")) -> list[str]:
    """"a,b" as distinct known views in order; ValueError for others or none."""
    names = list(dict.fromkeys(p.strip().lower() for p in text.split(",") if p.strip()))
    if not names or not set(names) <= set(known):
        raise ValueError(f"{text} are not views of {list(known)}")
    return names


def yaml_quote(value: object) -> str:
    """A double-quoted YAML scalar: backslashes and quotes are escaped, nothing else."""
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'
