"""Choosing K, representatives and regions: normalised candidate scores, eligibility, naming rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import norm2


def min_max(c: str, reverse: bool = False) -> Column:
    """0 to 1 over all candidates; a constant is 0."""
    w = Window.partitionBy()
    low, high = F.min(c).over(w), F.max(c).over(w)
    value = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)
    return F.when(high > low, 1 - value).otherwise(0.0) if reverse else value


def size_threshold(rows: int, least: int, ratio: float) -> int:
    return max(least, math.ceil(ratio * rows))


def select_k(metrics: DataFrame, score: str = "score", eligible: str = "eligible", diagnostic: bool = False, sizes: str | None = None) -> DataFrame:
    """(k, score, overridden): the eligible row of the highest score, the lowest k of equal ones.

    Where none is eligible, the job fails; for diagnosis the best of those whose sizes hold is taken, or of all.
    """
    rank = F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), -F.col("k"))
    row = F.struct("k", score)
    of = lambda ok: F.max_by(F.when(ok, row), F.when(ok, rank))
    found = metrics.agg(of(F.col(eligible)).alias("b"), of(F.col(sizes) if sizes else F.lit(True)).alias("s"), of(F.lit(True)).alias("a"), F.count("*").alias("n"))
    of_any = F.coalesce("b", "s", "a") if diagnostic else F.col("b")
    k = of_any["k"]
    if not diagnostic:
        k = F.coalesce(k, F.raise_error(F.concat(F.lit("no K of "), F.col("n").cast("string"), F.lit(" meets the bounds"))).cast(metrics.schema["k"].dataType))
    return found.select(k.alias("k"), of_any[score].alias(score), F.isnull("b").alias("overridden"))


def elbow(metrics: DataFrame, value: str = "bic") -> DataFrame:
    """(k): where the second difference of the value over ascending k is largest; the k of least value of fewer than three."""
    w = Window.orderBy("k")  # a row a candidate
    bend = F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w)
    each = metrics.select("k", value, bend.alias("bend"))
    best = F.max_by("k", F.when(F.col("bend").isNotNull(), F.struct("bend", -F.col("k"))))
    return each.agg(F.coalesce(best, F.min_by("k", F.struct(value, "k"))).alias("k"))


def posterior_margin(probabilities: Column) -> Column:
    """Difference of the two largest of an array; 1 for a single one."""
    down = F.sort_array(probabilities, asc=False)
    return F.when(F.size(down) < 2, 1.0).otherwise(down[0] - F.get(down, F.lit(1)))


def composite(metrics: DataFrame, bic: float = 0.30, silhouette: float = 0.30, size: float = 0.20, stability: float = 0.20, mask: float = 0.15) -> DataFrame:
    """metrics (k, bic, silhouette, min_size, size_needed, stability, mask_nmi, mask_purity) with composite_score."""
    fits = F.least(F.lit(1.0), F.col("min_size") / F.greatest(F.col("size_needed"), F.lit(1)))
    score = bic * min_max("bic", reverse=True) + silhouette * min_max("silhouette") + size * fits + stability * min_max("stability")
    return metrics.withColumn("composite_score", score - mask * 0.5 * (F.coalesce("mask_nmi", F.lit(0.0)) + F.coalesce("mask_purity", F.lit(0.0))))


def semantic_composite(metrics: DataFrame, mask: float = 0.15) -> DataFrame:
    """composite() of equal weights and a mask penalty of a quarter at least."""
    return composite(metrics, 0.25, 0.25, 0.25, 0.25, max(mask, 0.25))


def macro_micro_score(gated: bool = False) -> Column:
    """Of columns macro_silhouette, final_silhouette, seed_ari, purity_20, separation, negative, mask_nmi."""
    value = lambda c, d=0.0: F.coalesce(F.nanvl(c, F.lit(None)), F.lit(d))
    if gated:
        score = 0.35 * F.col("macro_silhouette") + 0.20 * F.col("final_silhouette") + 0.20 * F.col("seed_ari") + 0.15 * value("purity_20") + 0.10 * F.least(F.lit(1.0), value("separation")) - 0.10 * value("negative", 1.0)
    else:
        score = 0.35 * F.col("macro_silhouette") + 0.25 * F.col("final_silhouette") + 0.25 * F.col("seed_ari")
    return score - 0.25 * value("mask_nmi")


def latent_score() -> Column:
    """Of columns icl, silhouette, seed_ari, purity_20, separation, margin, negative over all candidates."""
    value = lambda c, d=0.0: F.coalesce(F.nanvl(c, F.lit(None)), F.lit(d))
    return (
        0.35 * min_max("icl", reverse=True) + 0.20 * min_max("silhouette") + 0.15 * min_max("seed_ari") + 0.15 * value("purity_20")
        + 0.10 * F.least(F.lit(1.0), value("separation")) + 0.05 * min_max("margin") - 0.05 * value("negative", 1.0)
    )


def select_bounded(metrics: DataFrame, score: str, gates: list[str], bound: str) -> DataFrame:
    """(k, score, best_unbounded_k, forced, gap): the best row that meets all gates and the bound of total K, beside the best of the gates alone."""
    ok = F.lit(True)
    for g in gates:
        ok = ok & F.col(g)
    rank = F.struct(F.col(score), -F.col("k"))
    row = F.struct("k", F.col(score).alias("v"))
    found = metrics.agg(F.max_by(F.when(ok & F.col(bound), row), F.when(ok & F.col(bound), rank)).alias("b"), F.max_by(F.when(ok, row), F.when(ok, rank)).alias("u"))
    k = F.coalesce(F.col("b.k"), F.raise_error(F.lit("no candidate meets the gates and the bounds of total K")).cast("bigint"))
    return found.select(k.alias("k"), F.col("b.v").alias(score), F.col("u.k").alias("best_unbounded_k"), (F.col("u.k") != F.col("b.k")).alias("forced"), F.greatest(F.lit(0.0), F.col("u.v") - F.col("b.v")).alias("gap"))


def canonical_order(df: DataFrame, cluster: str, norm: str, x: str, y: str) -> DataFrame:
    """df with `ordinal`: its cluster's place by mean norm, then by the angle of the mean difference, then by number."""
    means = df.groupBy(cluster).agg(F.avg(norm).alias("_n"), F.atan2(F.avg(y), F.avg(x)).alias("_a"))
    place = means.select(cluster, (F.row_number().over(Window.orderBy("_n", "_a", cluster)) - 1).alias("ordinal"))  # a row a cluster
    return df.join(F.broadcast(place), cluster)


def region_score(silhouette: Column, stability: Column, balance: Column, purity: Column, separation: Column, negative: Column) -> Column:
    """Score of a balanced partition of the plane."""
    value = lambda c, d: F.coalesce(c, F.lit(d))
    return 0.32 * value(silhouette, -1.0) + 0.23 * stability + 0.15 * balance + 0.12 * value(purity, 0.0) + 0.13 * F.least(F.lit(1.0), value(separation, 0.0)) - 0.05 * value(negative, 1.0)


def representatives(df: DataFrame, limit: int, x: str = "bv", y: str = "ba", cluster: str = "cluster_id", artist: str = "artist", key: str = "idx") -> DataFrame:
    """Rows nearest to their cluster's centre, one for each named artist; blank artists all count."""
    centres = df.groupBy(cluster).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    d = F.round(norm2(F.col(x) - F.col("_x"), F.col(y) - F.col("_y")), 9)
    each = df.join(F.broadcast(centres), cluster).withColumn("_d", d)  # a row a cluster
    of_artist = F.row_number().over(Window.partitionBy(cluster, artist).orderBy("_d", key))
    each = each.withColumn("_n", of_artist).filter((F.col(artist) == "") | (F.col("_n") == 1))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy("_d", key))
    return each.withColumn("place", place).filter(F.col("place") <= limit).drop("_x", "_y", "_d", "_n")


def region_name(v: Column, a: Column, number: Column, tokens: Column | None = None) -> Column:
    """Name of a region by its centre, with tokens as a hint for low arousal."""
    hint = F.lit(False) if tokens is None else F.lower(tokens).rlike("nostalgic|missing|melancholic")
    out = (
        F.when((v >= 0.88) & (a >= 0.75), "Euphoric Excitement")
        .when((v >= 0.68) & (a >= 0.45), "Bright Romantic Vitality")
        .when((v >= 0.60) & (a < 0.35), "Restorative Calm")
        .when((v < 0.35) & (a < 0.50), "Lonely Melancholy")
        .when((a < 0.50) & (hint | (v >= 0.35)), "Bittersweet Nostalgia")
        .when((v < 0.50) & (a >= 0.50), "Agitated Negative-Active")
        .when((v >= 0.50) & (a >= 0.50), "Positive Energetic")
    )
    return F.coalesce(out, F.concat(F.lit("Affect Region "), number.cast("string")))


def subtype_name(dv: Column, da: Column, norm: Column) -> Column:
    """Name of a tension subtype by its means."""
    parts = F.concat_ws(
        " + ",
        F.when(dv >= 0.05, "Lyric Valence Uplift").when(dv <= -0.05, "Lyric Valence Tempering"),
        F.when(da >= 0.05, "Lyric Arousal Intensification").when(da <= -0.05, "Lyric Arousal Softening"),
    )
    calm = (norm < 0.08) & (F.abs(dv) < 0.05) & (F.abs(da) < 0.05)
    strong = F.concat(F.lit("High Cross-Modal Tension: "), F.when(parts == "", "Directionally Mixed").otherwise(parts))
    return F.when(calm, "Affective Concordance").when(norm >= 0.18, strong).when(parts == "", "Affective Concordance").otherwise(parts)
