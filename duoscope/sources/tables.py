"""Readers and writers: schema-first CSV and TSV, JSON splits, Parquet layouts, and stored intermediate tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import remove_at_end, shared_folder


def read_csv(spark: SparkSession, path: str, separator: str = ",", schema: T.StructType | None = None) -> DataFrame:
    """A table with a header line, all columns as trimmed-name strings unless a schema is given; a byte-order mark is dropped."""
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", "UTF-8").option("multiLine", False)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)
    return df.toDF(*(c.removeprefix("\ufeff").strip() for c in df.columns))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return read_csv(spark, path, "\t", schema)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(split, idx) from a JSON object of splits, each a list or an object with indices; validate is val."""
    text = F.col("value")
    whole = spark.read.text(path, wholetext=True)
    lists = F.from_json(text, "map<string,string>")
    each = whole.select(F.explode(lists).alias("split", "body"))
    ids = F.coalesce(F.from_json("body", "struct<indices:array<bigint>>")["indices"], F.from_json("body", "array<bigint>"))
    return each.select(F.when(F.lower("split") == "validate", "val").otherwise(F.lower("split")).alias("split"), F.explode(ids).alias("idx"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_rankings(df: DataFrame, path: str) -> None:
    """One folder for each query and system, rows by rank."""
    df.repartition("query_id", "system").sortWithinPartitions("rank").write.mode("overwrite").partitionBy("query_id", "system").parquet(path)


def split_json(df: DataFrame, key: str, split: str = "split", order: str = "idx") -> DataFrame:
    """(split, json): the ids of each split in order, for interchange at manifest size."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(order, key))), lambda s: s[key])
    return df.groupBy(split).agg(F.to_json(F.struct(ids.alias("indices"))).alias("json"))


def with_ordinal(df: DataFrame) -> DataFrame:
    """df with `ordinal`, ascending in file order for a single file; gaps are allowed."""
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, failing at run time if a key repeats."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{keys} repeats")).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a materialised stage with a short lineage, which goes when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def markdown(df: DataFrame, limit: int = 20) -> str:
    """The first rows as a Markdown table; the limit is the feature."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def load_json(path: str) -> dict:
    """A JSON object, or {} where the file is not there."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except FileNotFoundError:
        return {}
    return found if isinstance(found, dict) else {}
