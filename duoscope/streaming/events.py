"""Structured Streaming extensions over events (not part of the batch operators): windowed rates and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Event files as a stream, at most some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)


def windowed(df: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count, sum and mean by window and kind; state of windows older than the watermark is dropped."""
    timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), kind, "n", "total", "mean")


def first_seen(df: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once, while the watermark keeps it."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
