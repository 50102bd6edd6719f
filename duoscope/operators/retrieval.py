"""Ranking rows against declarative queries under three systems, pooling, grading and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, clip01, finite, norm2, number_or
from ..functions.text import keyword_grade

# The six catalog queries as (id, region or -1, dv, da, strength, complexity, role, mixture).
QUERIES = [
    ("volatile_high_tension", 2, 0.0, 1.0, "high", "complex_or_high", "", ""),
    ("bittersweet_lyrical_lift", 0, 1.0, 1.0, "moderate_or_high", "mild_or_complex", "", ""),
    ("gentle_warmth_lyrical_lift", 1, 1.0, 1.0, "moderate_or_high", "", "", ""),
    ("audio_led_exuberance_dark_lyrics", 3, -1.0, -1.0, "moderate_or_high", "complex_or_high", "", ""),
    ("boundary_or_ambivalent_affect", -1, 0.0, 0.0, "", "high", "", "boundary_blend_or_strong_secondary_affect"),
    ("concordant_region_prototype", -1, 0.0, 0.0, "low", "simple", "prototype_or_representative", ""),
]
# Centres of regions without rows.
FALLBACK_CENTRES = {0: (0.25, 0.25), 1: (0.65, 0.30), 2: (0.25, 0.80), 3: (0.80, 0.75)}
SYSTEMS = ["va_only", "va_cluster_profile", "full"]
# Sources that are not evidence.
REJECTED = ["genius", "lyrics", "reddit", "youtube", "amazon", "spotify", "forum", "blogspot"]
DEPTH = 20
EPS = 1e-8


QUERY_SCHEMA = "query_id string, target int, q_dv double, q_da double, strength string, complexity_target string, role string, mixture string, va_target int"


def query_table(spark: SparkSession) -> DataFrame:
    """The built-in catalogue; sources.query_catalog reads one of a user's own."""
    return spark.createDataFrame([(*q, q[1]) for q in QUERIES], QUERY_SCHEMA)


def centres(df: DataFrame, x: str = "bv", y: str = "ba", cluster: str = "cluster_id") -> DataFrame:
    """(target, tv, ta): mean point of each region, or the fixed one where it has no complete row."""
    fixed = df.sparkSession.createDataFrame([(k, *v) for k, v in FALLBACK_CENTRES.items()], "target int, fv double, fa double")
    means = df.filter(finite(x).isNotNull() & finite(y).isNotNull()).groupBy(F.col(cluster).alias("target")).agg(F.avg(x).alias("mv"), F.avg(y).alias("ma"))
    return fixed.join(means, "target", "left").select("target", F.coalesce("mv", "fv").alias("tv"), F.coalesce("ma", "fa").alias("ta"))


def crossed(df: DataFrame, queries: DataFrame | None = None, x: str = "bv", y: str = "ba") -> DataFrame:
    """Each row with each query, its target point and the scales: a broadcast of as many rows as there are queries."""
    queries = query_table(df.sparkSession) if queries is None else queries
    queries = queries if "va_target" in queries.columns else queries.withColumn("va_target", F.col("target"))
    scales = df.agg(F.stddev_pop(finite(x)).alias("sv"), F.stddev_pop(finite(y)).alias("sa"))
    told = queries.join(centres(df, x, y).withColumnRenamed("target", "va_target"), "va_target", "left").crossJoin(scales)
    return df.crossJoin(F.broadcast(told))


def va_similarity(x: str = "bv", y: str = "ba") -> Column:
    sv, sa = (F.when(F.col(c) > EPS, F.col(c)).otherwise(1.0) for c in ("sv", "sa"))
    d = norm2((finite(x) - F.col("tv")) / sv, (finite(y) - F.col("ta")) / sa)
    return F.when(F.col("va_target") < 0, 1.0).otherwise(F.exp(-0.5 * F.coalesce(d, F.lit(10.0)) * F.coalesce(d, F.lit(10.0))))


def _weight(number: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for r in range(4):
        out = out.when(number == r, clip01(f"w_{r}"))
    return out


def region_match() -> Column:
    return F.when(F.col("target") < 0, clip01("region_confidence")).otherwise(_weight(F.col("target")))


def blend_ratio() -> Column:
    own = F.coalesce(_weight(F.col("cluster_id")), clip01("region_confidence"))
    other = F.greatest(*(F.when(F.col("cluster_id") != r, clip01(f"w_{r}")).otherwise(0.0) for r in range(4)))
    return clip(other / F.greatest(own, F.lit(EPS)), 0, 1.5) / 1.5


def boundary_score() -> Column:
    margin = number_or("region_margin", 1.0)
    return F.greatest(F.when(margin <= 0, 1.0).otherwise(clip(1 - margin, 0, 1)), blend_ratio(), 1 - clip01("region_typicality"))


def prototype_score() -> Column:
    return 0.65 * clip01("region_typicality") + 0.35 * clip((number_or("region_margin") + 0.25) / 1.25, 0, 1)


def geometry_match() -> Column:
    lifted = F.greatest(clip01("tension_percentile"), 1 - clip01("region_typicality"))
    return (
        F.when(F.col("role") == "prototype_or_representative", prototype_score())
        .when(F.col("mixture") == "boundary_blend_or_strong_secondary_affect", boundary_score())
        .when(F.col("strength").isin("high", "moderate_or_high"), lifted)
        .otherwise(prototype_score())
    )


def tension_match() -> Column:
    qn, sn = norm2("q_dv", "q_da"), norm2(number_or("dv"), number_or("da"))
    cosine = (number_or("dv") * F.col("q_dv") + number_or("da") * F.col("q_da")) / (sn * qn)
    direction = F.when(qn <= EPS, 1.0).when(sn <= EPS, 0.5).otherwise((clip(cosine, -1, 1) + 1) / 2)
    s = clip01("tension_percentile")
    strength = F.when(F.col("strength") == "high", s).when(F.col("strength") == "moderate_or_high", F.least(F.lit(1.0), s / 0.60)).when(F.col("strength") == "low", 1 - s).otherwise(0.5)
    none = F.col("strength") == ""
    return F.when((qn <= EPS) & none, 0.5).when(qn <= EPS, strength).when(none, direction).otherwise(0.65 * direction + 0.35 * strength)


def complexity_match() -> Column:
    c = clip01("complexity")
    near = F.when((c >= 0.45) & (c <= 0.65), 1.0).otherwise(clip(1 - F.abs(c - 0.55) / 0.55, 0, 1))
    high = F.when(F.lower("complexity_level") == "highly complex / ambivalent", 1.0).otherwise(clip(c / 0.70, 0, 1))
    t = F.col("complexity_target")
    return F.when(t == "simple", 1 - c).when(t == "mild_or_complex", near).when(t == "complex_or_high", c).when(t == "high", high).otherwise(0.5)


def scores(df: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Every row, query and system with its score: one broadcast of the queries and a stack of three systems."""
    out = crossed(df, queries).withColumns({"s_va": va_similarity(), "s_region": region_match(), "s_tension": tension_match(), "s_complexity": complexity_match(), "s_geometry": geometry_match()})
    parts = {
        "va_only": F.col("s_va"),
        "va_cluster_profile": 0.50 * F.col("s_va") + 0.30 * F.col("s_region") + 0.10 * clip01("region_typicality") + 0.10 * F.col("s_geometry"),
        "full": 0.30 * F.col("s_va") + 0.20 * F.col("s_region") + 0.25 * F.col("s_tension") + 0.15 * F.col("s_complexity") + 0.10 * F.col("s_geometry"),
    }
    return out.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(k).alias("system"), v.alias("score")) for k, v in parts.items())))).select("*", "_s.system", "_s.score").drop("_s")


def top(df: DataFrame, depth: int = DEPTH, key: str = "track_id") -> DataFrame:
    """Ranks 1 to depth of each query and system: score down, then key. The limit is the feature."""
    w = Window.partitionBy("query_id", "system").orderBy(F.desc(F.round("score", 12)), key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= depth)


def reason() -> Column:
    base = F.format_string("C%d at balanced VA=(%.3f, %.3f)", F.col("cluster_id"), F.col("bv"), F.col("ba"))
    strength = F.when(clip01("tension_percentile") >= 0.80, "high cross-modal tension").otherwise("calibrated audio-lyric tension")
    return (
        F.when(F.col("system") == "va_only", F.concat(base, F.format_string("; VA similarity=%.3f", "s_va")))
        .when(F.col("system") == "va_cluster_profile", F.concat(base, F.format_string("; region match=%.3f; geometry match=%.3f", "s_region", "s_geometry")))
        .otherwise(F.concat(base, F.lit("; "), strength, F.format_string("; tension match=%.3f; ACS=%.3f", F.col("s_tension"), clip01("complexity"))))
    )


def pool(ranked: DataFrame, key: str = "track_id") -> DataFrame:
    """(query, key) with the systems that found it and its rank in each."""
    ranks = [F.max(F.when(F.col("system") == s, F.col("rank"))).alias(f"rank_{s}") for s in SYSTEMS]
    return ranked.groupBy("query_id", key).agg(F.array_join(F.sort_array(F.collect_set("system")), ",").alias("systems"), *ranks)  # three systems at most


def source_allowed(name: Column, url: Column) -> Column:
    return ~F.lower(F.concat_ws(" ", name, url)).rlike("|".join(REJECTED))


def grades(df: DataFrame, text: str, region_words: list[str], tension_words: list[str]) -> DataFrame:
    """region, tension and overall grades, 0 to 3, and a status."""
    region, tension = keyword_grade(text, region_words), keyword_grade(text, tension_words)
    out = df.withColumn("region_grade", region).withColumn("tension_grade", tension)
    out = out.withColumn("overall_grade", F.bround(0.45 * F.col("region_grade") + 0.55 * F.col("tension_grade")).cast("int"))
    against = F.lower(text).contains("contradict") | F.lower(text).contains("opposite")
    partial = (F.col("overall_grade") <= 1) & ((F.col("region_grade") > 0) | (F.col("tension_grade") > 0))
    return out.withColumn("status", F.when(partial, "partial").when(against & (F.col("overall_grade") == 0), "contradiction").otherwise("verified"))


def usable_labels(df: DataFrame, grade: str = "grade", status: str = "status") -> DataFrame:
    return df.withColumn(grade, finite(grade)).filter(F.col(grade).isNotNull() & ~F.coalesce(F.col(status), F.lit("")).isin("unverified", "needs_external_review"))


def gain(rel: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(place + 1.0)


def evaluate(ranked: DataFrame, labels: DataFrame, ks: list[int], key: str = "track_id") -> DataFrame:
    """(query, system, k): ndcg, mean relevance, precision of grade 2 and over, strong rate, judged. Unjudged counts 0."""
    met = ranked.select("query_id", "system", "rank", key).join(labels, ["query_id", key], "left").withColumn("rel", F.coalesce("grade", F.lit(0.0)))
    sizes = F.explode(F.array(*map(F.lit, ks))).alias("k")
    each = met.select("*", sizes).filter("rank <= k").groupBy("query_id", "system", "k").agg(
        F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.avg("rel").alias("mean_relevance"), F.count_if(F.col("rel") >= 2).alias("good"), F.count_if(F.col("rel") == 3).alias("strong"), F.count("grade").alias("judged"),
    )
    ideal = labels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), key)))
    ideal = ideal.select("*", sizes).filter("place <= k").groupBy("query_id", "k").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"))
    out = each.join(ideal, ["query_id", "k"], "left")
    ndcg = F.when(F.col("ideal") > EPS, F.col("dcg") / F.col("ideal"))
    return out.select("query_id", "system", "k", ndcg.alias("ndcg"), "mean_relevance", (F.col("good") / F.col("k")).alias("precision"), (F.col("strong") / F.col("k")).alias("strong_rate"), "judged")


def compare_systems(metrics: DataFrame, k: int = 10, base: str = "va_only") -> DataFrame:
    """Means of each system, and its win rate over the base by query at k."""
    means = metrics.groupBy("system").agg(F.avg("ndcg").alias("mean_ndcg"), F.avg("mean_relevance").alias("mean_relevance"), F.avg("precision").alias("mean_precision"), F.avg("strong_rate").alias("mean_strong"))
    at = metrics.filter(F.col("k") == k).select("query_id", "system", "mean_relevance")
    won = at.filter(F.col("system") != base).join(at.filter(F.col("system") == base).select("query_id", F.col("mean_relevance").alias("b")), "query_id")
    return means.join(won.groupBy("system").agg(F.avg((F.col("mean_relevance") > F.col("b")).cast("double")).alias("win_rate")), "system", "left")


# What is searched for beside an entity's name.
SEARCHES = ["review", "analysis", "interview"]


def search_strings(df: DataFrame, text: Column, kinds: list[str] | None = None) -> DataFrame:
    """df with `search`: three rows a row, the text with each kind of page that is asked for."""
    return df.withColumn("search", F.explode(F.array(*(F.concat(text, F.lit(f" {k}")) for k in kinds or SEARCHES))))
