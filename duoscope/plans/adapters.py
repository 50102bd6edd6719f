"""Views over the benchmark tables in the shape of two-view entities, the same in Spark and in DuckDB SQL.

tracks: one row an embedding, its first six components as points of two views and of the original plane.
song: a track with consensus, tension, cluster, subtype and the part's name and brand as title and artist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import norm2

# Names of tension subtypes by their number.
SUBTYPE_NAMES = ["modality-consistent", "bright lyric uplift", "dark tempering high tension"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    parts = [((F.col("embedding")[i].cast("double") + 1) / 2).alias(c) for i, c in enumerate(("av", "aa", "lv", "la", "ov", "oa"))]
    return e.select(
        F.concat(F.lit("t"), F.col("vec_id")).alias("track_id"), F.col("vec_id").alias("idx"), "label", (F.col("label") % 4).cast("int").alias("cluster_id"), *parts,
        (F.col("vec_id") % 11 != 0).alias("has_audio"), (F.col("vec_id") % 7 != 0).alias("has_lyrics"),
    )


def song(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts are merged in: their small files would be sent whole to the driver and every executor, by each job that reads songs."""
    t = tracks(spark, sf_dir)
    both = F.col("has_audio") & F.col("has_lyrics")
    for c, a, b in (("bv", "av", "lv"), ("ba", "aa", "la")):
        t = t.withColumn(c, F.when(both, (F.col(a) + F.col(b)) / 2).when(F.col("has_audio"), F.col(a)).when(F.col("has_lyrics"), F.col(b)).otherwise(0.5))
    t = t.withColumn("dv", F.when(both, F.col("lv") - F.col("av")).otherwise(0.0)).withColumn("da", F.when(both, F.col("la") - F.col("aa")).otherwise(0.0))
    kind = F.floor(F.col("label") / 4).cast("int")
    names = F.element_at(F.array(*map(F.lit, SUBTYPE_NAMES)), kind + 1)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genres"))
    t = t.withColumn("norm", norm2("dv", "da")).withColumn("tension_label", F.concat(F.lit("T"), kind)).withColumn("tension_name", names)
    return t.join(part.hint("merge"), "idx", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "artist", "genres")})


TRACKS = """t AS (SELECT 't' || vec_id AS track_id, vec_id AS idx, label, (label % 4)::INT AS cluster_id,
 (embedding[1]::DOUBLE + 1) / 2 AS av, (embedding[2]::DOUBLE + 1) / 2 AS aa, (embedding[3]::DOUBLE + 1) / 2 AS lv,
 (embedding[4]::DOUBLE + 1) / 2 AS la, (embedding[5]::DOUBLE + 1) / 2 AS ov, (embedding[6]::DOUBLE + 1) / 2 AS oa,
 vec_id % 11 <> 0 AS has_audio, vec_id % 7 <> 0 AS has_lyrics FROM embeddings)"""

_NAMES = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SUBTYPE_NAMES))
SONG = f"""{TRACKS},
s0 AS (SELECT *, CASE WHEN has_audio AND has_lyrics THEN (av + lv) / 2 WHEN has_audio THEN av WHEN has_lyrics THEN lv ELSE 0.5 END AS bv,
 CASE WHEN has_audio AND has_lyrics THEN (aa + la) / 2 WHEN has_audio THEN aa WHEN has_lyrics THEN la ELSE 0.5 END AS ba,
 CASE WHEN has_audio AND has_lyrics THEN lv - av ELSE 0.0 END::DOUBLE AS dv, CASE WHEN has_audio AND has_lyrics THEN la - aa ELSE 0.0 END::DOUBLE AS da FROM t),
s AS (SELECT s0.*, sqrt(dv * dv + da * da) AS norm, 'T' || (label // 4) AS tension_label, CASE label // 4 {_NAMES} END AS tension_name,
 coalesce(p_name, '') AS title, coalesce(p_brand, '') AS artist, coalesce(p_type, '') AS genres FROM s0 LEFT JOIN part ON p_partkey = idx)"""
