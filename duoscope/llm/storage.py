"""The folder that driver and executors share: Spark's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..runtime import remove_at_end, shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str = "snappy", path: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and no lost executor undoes it.

    zstd works on the heap; snappy's buffers are outside of it and stay until the heap is collected, so that many small
    files add up. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
