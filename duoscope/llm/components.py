"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, remove, scratch


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for edges (a, b) of integers; the component is its least node. Single nodes aren't listed,
    nor are edges with a null or from a node to itself.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round. Minima
    are pre-aggregated and written too: the join then has a plain exchange on either side, which AQE splits at a node of
    high degree.
    """
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        e = both(e) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = cut(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", path=(used := scratch(spark, "least")))
        made.append(used)
        met = e.join(least, "u")
        met = met.filter("v > u") if large else met
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    made: list[str] = []  # by this round
    at = scratch(spark, "edges")
    state, before = cut(edges.filter("a <> b").select("a", "b").distinct(), "edges", path=at), None
    for _ in range(most):
        following = scratch(spark, "edges")
        half = scratch(spark, "half")
        state = cut(star(cut(star(state, True), "half", path=half), False), "edges", path=following)
        for used in (at, half, *made):
            remove(spark, used)
        made.clear()
        at = following
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select("b", "b").distinct())
