"""Profiles of rows inside fixed regions: distances, soft weights, typicality, tension subtypes, roles and descriptors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import decimals, norm2
from ..functions.text import consistent, contains_any, has_encoding_issue
from ..sources.tables import stored
from .statistics import EPS, percentiles_with_all, robust_scale, with_many_ranks, with_ranks

MIN_GROUP = 3
# Descriptors of regions 0 to 3, and of kinds of tension.
REGION_DESCRIPTORS = {
    0: ["subdued melancholy", "low arousal", "melancholic", "introspective", "somber"],
    1: ["gentle warmth", "calm-positive", "warm", "soft", "romantic"],
    2: ["volatile intensity", "negative-active", "tense", "aggressive", "high arousal"],
    3: ["playful vitality", "positive-active", "energetic", "bright", "danceable"],
}
TENSION_DESCRIPTORS = {
    "concordant": ["affective concordance", "audio-lyric agreement"],
    "uplift": ["lyric valence uplift", "lyrics brighten the affect"],
    "tempering": ["lyric valence tempering", "lyrics darken the affect"],
    "intensification": ["lyric arousal intensification", "lyrics intensify the affect"],
    "softening": ["lyric arousal softening", "lyrics soften the affect"],
    "high_tension": ["high cross-modal tension", "audio-lyric contrast"],
}
KEYWORDS = {
    "concordant": ["consistent", "concordant", "agreement", "aligned"],
    "uplift": ["bright", "uplift", "lift", "brighter"],
    "tempering": ["dark", "temper", "shadow", "darker"],
    "intensification": ["intensif", "activation", "activated"],
    "softening": ["soft", "soften", "deactivat"],
}
# Titles that are not for display (a pattern of whole words).
EXPLICIT = r"(?i)\b(fuck(?:ing|er|ed)?|shit|bitch|cunt|dick|pussy|asshole|bastard|motherfucker|whore|slut)\b"
REGIONS = range(4)


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def region_table(df: DataFrame, x: str = "bv", y: str = "ba", cluster: str = "cluster_id") -> DataFrame:
    """(cluster, cx, cy, radius): centres, and medians of members' distances (of all rows for small or flat regions)."""
    centres = df.groupBy(cluster).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count("*").alias("members"))
    met = df.join(F.broadcast(centres), cluster).withColumn("d", norm2(F.col(x) - F.col("cx"), F.col(y) - F.col("cy")))  # a row a region
    medians = stored(percentiles_with_all(met.filter(F.col("d") > EPS).select(cluster, "d"), F.col("d"), 0.5, cluster), "radii")  # a row a region
    everywhere = medians.agg(F.coalesce(F.max("everywhere"), F.lit(1.0)).alias("everywhere"))
    own = centres.join(medians.select(cluster, F.col("own").alias("m")), cluster, "left")
    radius = F.when(F.col("members") < MIN_GROUP, F.col("everywhere")).otherwise(F.coalesce("m", "everywhere"))
    return own.crossJoin(F.broadcast(everywhere)).select(cluster, "cx", "cy", F.greatest(radius, F.lit(EPS)).alias("radius"))


def region_profiles(df: DataFrame, x: str = "bv", y: str = "ba", cluster: str = "cluster_id") -> DataFrame:
    """D_0..3 and w_0..3 (null for a region without members), region_confidence, region_typicality, nearest
    alternative with its weight, and region_margin (alternative less own distance). One broadcast row of four regions."""
    table = region_table(df, x, y, cluster)
    wide = table.groupBy().agg(*(F.max(F.when(F.col(cluster) == r, F.col(c))).alias(f"{c}{r}") for r in REGIONS for c in ("cx", "cy", "radius")))
    out = df.crossJoin(F.broadcast(wide))
    out = out.withColumns({f"D_{r}": norm2(F.col(x) - F.col(f"cx{r}"), F.col(y) - F.col(f"cy{r}")) / F.col(f"radius{r}") for r in REGIONS})
    low = F.least(*(F.col(f"D_{r}") for r in REGIONS))
    raw = {r: F.exp(-0.5 * (F.col(f"D_{r}") * F.col(f"D_{r}") - low * low)) for r in REGIONS}
    total = add([F.coalesce(raw[r], F.lit(0.0)) for r in REGIONS])
    out = out.withColumns({f"w_{r}": raw[r] / total for r in REGIONS})
    own = lambda name: reduce(lambda a, r: a.when(F.col(cluster) == r, F.col(f"{name}_{r}")), REGIONS, F.when(F.lit(False), 0.0))
    out = out.withColumn("D_own", own("D")).withColumn("region_confidence", own("w"))
    others = F.array_min(F.filter(F.array(*(F.struct(F.col(f"D_{r}").alias("d"), F.lit(r).alias("r"), F.col(f"w_{r}").alias("w")) for r in REGIONS)), lambda s: s["d"].isNotNull() & (s["r"] != F.col(cluster))))
    out = out.withColumn("_alt", others)
    out = out.withColumns({"nearest_alt": F.col("_alt.r"), "nearest_alt_weight": F.col("_alt.w"), "region_margin": F.col("_alt.d") - F.col("D_own")})
    out = with_ranks(out, F.col("D_own"), cluster, centrality="region_typicality")
    return out.drop("_alt", *(f"{c}{r}" for r in REGIONS for c in ("cx", "cy", "radius")))


def mahalanobis(df: DataFrame, x: str = "bv", y: str = "ba", cluster: str = "cluster_id") -> DataFrame:
    """df with M_own: distance to the own region's centre by its shrunk covariance."""
    s = df.groupBy(cluster).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count("*").alias("n"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vxy"))
    small = F.col("n") < MIN_GROUP
    vx, vy, vxy = (F.when(small, d).otherwise(F.col(c)) for c, d in (("vx", 1.0), ("vy", 1.0), ("vxy", 0.0)))
    trace = F.greatest((vx + vy) / 2, F.lit(EPS))
    s = s.select(cluster, "cx", "cy", (0.9 * vx + 0.1 * trace + EPS).alias("a"), (0.9 * vy + 0.1 * trace + EPS).alias("b"), (0.9 * vxy).alias("c"))
    out = df.join(F.broadcast(s), cluster)  # a row a region
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    square = (F.col("b") * dx * dx - 2 * F.col("c") * dx * dy + F.col("a") * dy * dy) / (F.col("a") * F.col("b") - F.col("c") * F.col("c"))
    return out.withColumn("M_own", F.sqrt(square)).drop("cx", "cy", "a", "b", "c")


def tension_profiles(df: DataFrame, cluster: str = "cluster_id", label: str = "tension_label", key: str = "idx") -> DataFrame:
    """Robust z by region, distance to the own subtype's centre in its radii, softmax weight among the region's
    subtypes, typicality, and percentiles within the region of norm, differences and their sizes."""
    df = stored(df, "profiles")  # read four times below
    long = df.select(cluster, F.explode(F.create_map(F.lit("dv"), F.col("dv"), F.lit("da"), F.col("da"))).alias("axis", "value"))
    scale = robust_scale(long, "value", cluster, "axis")
    wide = scale.groupBy(cluster).agg(*(F.max(F.when(F.col("axis") == c, F.col(v))).alias(f"{n}_{c}") for c in ("dv", "da") for n, v in (("m", "center"), ("s", "scale"))))
    z = df.join(F.broadcast(wide), cluster).withColumns({f"z_{c}": (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in ("dv", "da")})  # a row a region
    z = stored(z, "scaled-tension")
    centres = z.groupBy(cluster, label).agg(F.avg("z_dv").alias("tx"), F.avg("z_da").alias("ty"), F.count("*").alias("members"))
    own = z.join(F.broadcast(centres), [cluster, label]).withColumn("d", norm2(F.col("z_dv") - F.col("tx"), F.col("z_da") - F.col("ty")))  # a row a subtype
    medians = stored(percentiles_with_all(own.filter(F.col("d") > EPS).select(cluster, label, "d"), F.col("d"), 0.5, cluster, label), "radii")  # a row a subtype
    everywhere = medians.agg(F.coalesce(F.max("everywhere"), F.lit(1.0)).alias("everywhere"))
    radii = centres.join(medians.select(cluster, label, F.col("own").alias("m")), [cluster, label], "left").crossJoin(F.broadcast(everywhere))
    radius = F.when(F.col("members") < MIN_GROUP, F.col("everywhere")).otherwise(F.coalesce("m", "everywhere"))
    subtypes = radii.select(cluster, F.col(label).alias("_label"), "tx", "ty", F.greatest(radius, F.lit(EPS)).alias("tr"))
    each = z.select(key, cluster, label, "z_dv", "z_da").join(F.broadcast(subtypes), cluster).withColumn("D", norm2(F.col("z_dv") - F.col("tx"), F.col("z_da") - F.col("ty")) / F.col("tr"))
    w = Window.partitionBy(key)
    low = F.min("D").over(w)
    each = each.withColumn("e", F.exp(-0.5 * (F.col("D") * F.col("D") - low * low)))
    each = each.withColumn("w", F.col("e") / F.sum("e").over(w)).filter(F.col("_label") == F.col(label))
    out = z.join(each.select(key, F.col("D").alias("D_tension"), F.col("w").alias("w_tension")).hint("merge"), key).drop("m_dv", "s_dv", "m_da", "s_da")
    value = F.col
    return with_many_ranks(out, key, {
        "tension_typicality": (value("D_tension"), [cluster, label], "centrality"), "tension_percentile": (value("norm"), [cluster], "ecdf"),
        "dv_percentile": (value("dv"), [cluster], "ecdf"), "da_percentile": (value("da"), [cluster], "ecdf"),
        "abs_dv_percentile": (F.abs("dv"), [cluster], "ecdf"), "abs_da_percentile": (F.abs("da"), [cluster], "ecdf"),
    })


def region_role(margin: Column, confidence: Column, typicality: Column) -> Column:
    return (
        F.when((margin < 0) | (confidence < 0.60), "boundary")
        .when((typicality >= 0.80) & (confidence >= 0.75) & (margin >= 0.50), "prototype")
        .when((typicality >= 0.50) & (confidence >= 0.70) & (margin >= 0.30), "representative")
        .otherwise("peripheral")
    )


def directional(percentile: Column, agreeing: Column, most: Column) -> Column:
    """Whether a tension is strong enough to be told by its direction."""
    return (percentile >= 0.35) & (~agreeing | ((percentile >= 0.60) & (most >= 0.75)))


def review_flags(df: DataFrame) -> DataFrame:
    """Roles, flags, candidate types and eligibility from a region and tension profile with title and artist."""
    out = df.withColumn("region_role", region_role(F.col("region_margin"), F.col("region_confidence"), F.col("region_typicality")))
    out = out.withColumns({
        "boundary_flag": F.col("region_role") == "boundary", "descriptor_conflict": F.col("nearest_alt_weight") > F.col("region_confidence"),
        "encoding_issue": has_encoding_issue("title", "artist"), "explicit_title": F.concat_ws(" ", "title", "artist").rlike(EXPLICIT),
    })
    case = (F.col("tension_percentile") >= 0.75) & (F.col("tension_typicality") >= 0.50) & (F.col("region_margin") > 0)
    role = (
        F.when(F.col("encoding_issue") | F.col("explicit_title"), "appendix_only")
        .when(F.col("boundary_flag") | F.col("descriptor_conflict"), "boundary_case")
        .when(case, "tension_case")
        .when(F.col("region_role") == "prototype", "region_prototype")
        .when(F.col("region_role") == "representative", "region_representative")
        .otherwise("appendix_only")
    )
    out = out.withColumn("selected_role", role)
    return out.withColumn("main_text_eligible", F.col("selected_role").isin("region_prototype", "region_representative", "tension_case"))


def tension_keys() -> dict[str, Column]:
    """For each kind of tension, whether a row is of it."""
    name = F.concat_ws(" ", "tension_label", "tension_name")
    agreeing, strength = consistent("tension_label", "tension_name"), F.col("tension_percentile")
    allowed = directional(strength, agreeing, F.greatest("abs_dv_percentile", "abs_da_percentile"))
    only = (agreeing & ~allowed) | (strength < 0.35)
    found = {k: contains_any(name, words) for k, words in KEYWORDS.items()}
    found["high_tension"] = (strength >= 0.75) | contains_any(name, ["high tension", "contrast"])
    none = ~reduce(lambda a, b: a | b, found.values())
    return {k: F.when(only, F.lit(k == "concordant")).otherwise(c | none if k == "concordant" else c) for k, c in found.items()}


def descriptors(df: DataFrame, key: str = "idx", most: int = 8) -> DataFrame:
    """(key, descriptor, raw, weight, place): the highest weight over all rules, over the row's highest; top `most`.

    Only rows that aren't at a boundary take descriptors of regions; the others name the two regions."""
    arrays: list[Column] = []

    def rule(names: list[Column | str], weight: Column, when: Column | None = None) -> None:
        w = weight if when is None else F.when(when, weight)
        for n in names:
            arrays.append(F.struct((F.lit(n) if isinstance(n, str) else n).alias("descriptor"), w.alias("raw")))

    own, boundary = F.col("region_confidence"), F.col("boundary_flag")
    rule(["boundary between assigned region and nearest alternative"], 1 + F.greatest(own, "nearest_alt_weight", F.lit(0.01)), boundary)
    rule([F.concat(F.lit("assigned region: C"), F.col("cluster_id"))], own * 0.5, boundary)
    rule([F.concat(F.lit("nearest alternative: C"), F.col("nearest_alt"))], F.col("nearest_alt_weight") * 0.5, boundary)
    for r, names in REGION_DESCRIPTORS.items():
        mine = F.col("cluster_id") == r
        rule(names, own * F.greatest(F.lit(0.25), "region_typicality"), ~boundary & mine)
        rule(names, F.least(F.col(f"w_{r}") * 0.25, F.greatest(own * 0.75, F.lit(0.01))), ~boundary & ~mine & (F.col(f"w_{r}") >= 0.15))
    strength = F.greatest(F.lit(0.35), "tension_percentile")
    for kind, holds in tension_keys().items():
        rule(TENSION_DESCRIPTORS[kind], F.col("w_tension") * strength * F.col("tension_typicality"), holds)
    allowed = directional(F.col("tension_percentile"), consistent("tension_label", "tension_name"), F.greatest("abs_dv_percentile", "abs_da_percentile"))
    base = strength * F.greatest(F.lit(0.5), "tension_typicality")
    for kind, c, up, percentile in (("uplift", "dv", True, "dv_percentile"), ("tempering", "dv", False, "abs_dv_percentile"), ("intensification", "da", True, "da_percentile"), ("softening", "da", False, "abs_da_percentile")):
        rule(TENSION_DESCRIPTORS[kind], base * F.col(percentile), allowed & ((F.col(c) > EPS) if up else (F.col(c) < -EPS)))
    each = df.select(key, F.explode(F.array(*arrays)).alias("s")).select(key, "s.descriptor", "s.raw").filter("raw > 0")
    best = each.groupBy(key, "descriptor").agg(F.max("raw").alias("raw"))
    best = best.withColumn("weight", decimals(F.col("raw") / F.max("raw").over(Window.partitionBy(key)), 6)).withColumn("raw", decimals("raw", 6))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), F.desc("raw"), "descriptor"))
    return best.withColumn("place", place).filter(F.col("place") <= most)
