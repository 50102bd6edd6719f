"""Alignment and merge joins: first row by an explicit ordinal, checked one-to-one joins, filling full joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def first_rows(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def pair_index(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with pair_index from 0 in the given order, numbered within ranges so that no task sees all rows.

    Ranges are stored: bounds are drawn anew when they are computed again, and sizes would be of other ranges."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranges")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    numbered = ranged.withColumn("_in", inside)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # one row a partition
    return numbered.join(F.broadcast(offsets), "_part").withColumn("pair_index", F.col("_before") + F.col("_in") - 1).drop("_part", "_at", "_in", "_size", "_before")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Left join that fails in the plan if the right side repeats a key or, when strict, lacks one."""
    counted = right.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    checked = counted.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("the right side repeats a key")).cast("int")).otherwise(F.lit(1)))
    out = left.join(checked.drop("_n"), keys, "left")
    if strict:
        out = out.withColumn("_ok", F.when(F.col("_ok").isNull(), F.raise_error(F.lit("a row has no partner")).cast("int")).otherwise(F.col("_ok")))
    return out.filter("_ok is null or _ok = 1").drop("_ok")


def merge_fill(base: DataFrame, addition: DataFrame, key: str) -> DataFrame:
    """Full join in which base wins and addition fills nulls, with a conflict_<column> flag for each shared column."""
    shared = [c for c in addition.columns if c in base.columns and c != key]
    only = [c for c in addition.columns if c not in base.columns]
    b, a = base.alias("b"), addition.alias("a")
    out = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "full")
    numeric = {c for c, t in base.dtypes if t in ("double", "float", "int", "bigint")}

    def differs(c: str) -> Column:
        x, y = F.col(f"b.{c}"), F.col(f"a.{c}")
        return F.coalesce(F.round(x.cast("double"), 8) != F.round(y.cast("double"), 8) if c in numeric else x != y, F.lit(False))

    own = [F.col(f"b.{c}") for c in base.columns if c != key and c not in shared]
    return out.select(
        F.coalesce(f"b.{key}", f"a.{key}").alias(key), *own, *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in shared),
        *(F.col(f"a.{c}") for c in only), *(differs(c).alias(f"conflict_{c}") for c in shared),
    )


def with_fallback_key(left: DataFrame, right: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """value of right by (first, second), else by second alone where right's first is empty; the last row of a key wins.

    right has an ordinal column `n`."""
    last = first_rows(right, [first, second], F.desc("n"))
    exact = last.filter(F.col(first) != "").select(first, second, F.col(value).alias("_exact"))
    loose = last.filter(F.col(first) == "").select(second, F.col(value).alias("_loose"))
    return left.join(exact, [first, second], "left").join(loose, second, "left").withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def select_rows(chosen: DataFrame, everything: DataFrame, key: str, overrides: list[str]) -> DataFrame:
    """Rows of everything for the chosen keys, with chosen's values where they aren't null."""
    side = chosen.select(key, *(F.col(c).alias(f"_{c}") for c in overrides))
    out = everything.join(side, key)
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in overrides}).drop(*(f"_{c}" for c in overrides))


def missing_keys(chosen: DataFrame, everything: DataFrame, key: str) -> DataFrame:
    return chosen.select(key).distinct().join(everything.select(key), key, "left_anti")


def previous_split(df: DataFrame, before: DataFrame, key: str, old: str, fallback: Column, out: str = "split") -> DataFrame:
    """df with its split of an earlier manifest (key, old), or the fallback where it has none of the three."""
    met = df.join(before.select(key, F.col(old).alias("_old")), key, "left")
    return met.withColumn(out, F.when(F.col("_old").isin("train", "val", "test"), F.col("_old")).otherwise(fallback)).drop("_old")
