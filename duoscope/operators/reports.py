"""Tables that reports are made of: candidates and representatives, counts and violations, comparisons of runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.text import cluster_number, consistent, report_text, truthy
from ..schema import REGIONS

# Titles that a reviewer asked for in region 2.
TITLE_HINTS = ["born in the u.s.a.", "price you pay", "give me it", "maimed and slaughtered", "room 13"]
MAIN_TYPES = ["region_prototype", "region_representative", "tension_case"]
SCORE_ORDER = ["balanced_region_score", "latent_va_score", "macro_micro_score", "composite_score", "semantic_composite_score", "silhouette"]


def top_rows(df: DataFrame, group: Sequence[str], limit: int, *order: Column | str) -> DataFrame:
    """df with `place` in its group by the order, the first `limit` of each group (the limit is the feature)."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= limit)


def with_role(df: DataFrame, roles: Sequence[str], role: str = "selected_role") -> DataFrame:
    return df.filter(F.col(role).isin(list(roles)))


def region_order(cluster: str = "cluster_id", title: str = "title", key: str = "idx") -> list[Column]:
    """Hinted titles of region 2 first, then typicality, confidence and tension percentile downwards, then the id."""
    hinted = ((F.col(cluster) == 2) & F.lower(F.trim(title)).isin(TITLE_HINTS)).cast("int")
    return [F.desc(hinted), F.desc(F.round("region_typicality", 9)), F.desc(F.round("region_confidence", 9)), F.desc(F.round("tension_percentile", 9)), F.col(key)]


def tension_order(key: str = "idx") -> list[Column]:
    """Tension percentile, tension typicality and confidence downwards, then the id."""
    return [F.desc(F.round("tension_percentile", 9)), F.desc(F.round("tension_typicality", 9)), F.desc(F.round("region_confidence", 9)), F.col(key)]


def final_candidates(df: DataFrame, cluster: str = "cluster_id", key: str = "idx", regions: int = 3, tensions: int = 2) -> DataFrame:
    """df with final_role and final_rank: of the eligible rows of each cluster the first by region, then by tension among the others."""
    safe = df.filter("main_text_eligible")
    first = top_rows(safe.filter(F.col("region_role").isin("prototype", "representative")), [cluster], regions, *region_order(cluster, key=key)).withColumn("final_role", F.lit("region_candidate"))
    left = safe.filter(F.col("selected_role") == "tension_case").join(first.select(key), key, "left_anti").select(*df.columns)
    second = top_rows(left, [cluster], tensions, *tension_order(key)).withColumn("final_role", F.lit("tension_case"))
    return first.unionByName(second).withColumnRenamed("place", "final_rank")


def boundary_rows(df: DataFrame, cluster: str = "cluster_id", key: str = "idx") -> DataFrame:
    """The boundary case of least margin of each cluster, of equal ones that of higher confidence, then the first id."""
    cases = df.filter(F.col("selected_role") == "boundary_case")
    return top_rows(cases, [cluster], 1, F.asc(F.round("region_margin", 9)), F.desc(F.round("region_confidence", 9)), key).drop("place")


def token_ranking(tests: DataFrame, group: str, limit: int = 10) -> DataFrame:
    """The first tokens of each group by q, p, enrichment and support downwards, and name."""
    return top_rows(tests, [group], limit, F.asc(F.round("q", 12)), F.asc(F.round("p", 12)), F.desc(F.round("enrichment", 9)), F.desc("support"), "token")


def display_columns(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """The preferred columns that are there, in that order."""
    return df.select(*(c for c in preferred if c in df.columns))


# ---------------------------------------------------------------- counts


def label_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows): how often each value of the columns stands; nulls are the value null."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("v")
    return df.select(each).select("v.*").groupBy("column", "value").agg(F.count("*").alias("rows"))


def missing_counts(df: DataFrame, columns: Sequence[str], texts: Sequence[str] = ("", "missing")) -> DataFrame:
    """(column, missing): nulls, blanks and the texts that stand for nothing, by column; one aggregate."""
    counts = df.agg(*(F.count_if(F.col(c).isNull() | F.trim(F.col(c).cast("string")).isin(list(texts))).alias(c) for c in columns))
    return counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*(F.col(c) for c in columns)))).alias("column", "missing"))


def directional_violations(df: DataFrame, label: str, mask: Column) -> Column:
    """Aggregate: rows of the mask whose label speaks of a direction."""
    words = "lift|amplif|reframed|uplift|intensif|soften|temper"
    return F.count_if(mask & F.lower(F.col(label)).rlike(words))


def interpretation_sanity(df: DataFrame, key: str = "idx") -> DataFrame:
    """One row: totals, boundary blends, high complexity, directional labels where tension is low, eligible rows."""
    low = F.col("tension_level") == "low"
    agreeing = consistent(F.col("tension_name")) & (F.col("tension_percentile") < 0.25)
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col("mixture_type") == "boundary_blend").alias("boundary_blend"),
        F.count_if(F.col("complexity_level") == "highly complex / ambivalent").alias("high_complexity"),
        directional_violations(df, "final_label", low).alias("low_tension_violations"), directional_violations(df, "final_label", agreeing).alias("consistent_violations"),
    )


def completeness(tokens: DataFrame, rows: DataFrame, fields: Sequence[str], key: str = "idx") -> DataFrame:
    """(key, completeness): share of the fields of which the row has a token (key, field, token)."""
    has = tokens.filter(F.col("field").isin(list(fields))).select(key, "field").distinct().groupBy(key).agg(F.count("*").alias("n"))
    return rows.select(key).join(has, key, "left").select(key, (F.coalesce("n", F.lit(0)) / float(len(fields))).alias("completeness"))


def weighted_ratios(df: DataFrame, ratio: str, size: str, least: float = 0.70) -> DataFrame:
    """One row: mean ratio by size, the least ratio, and the share of the size whose ratio is below `least`."""
    return df.agg((F.sum(F.col(ratio) * F.col(size)) / F.sum(size)).alias("weighted"), F.min(ratio).alias("minimum"), (F.sum(F.when(F.col(ratio) < least, F.col(size)).otherwise(0)) / F.sum(size)).alias("mixed"))


def run_means(tables: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """(dataset, rows, <column>_mean): a row a dataset; a column that a dataset lacks is null, an empty one has 0 rows."""
    out = []
    for name, df in tables.items():
        means = [(F.avg(finite(c)) if c in df.columns else F.lit(None).cast("double")).alias(f"{c}_mean") for c in columns]
        out.append(df.agg(F.count("*").alias("rows"), *means).select(F.lit(name).alias("dataset"), "rows", *(f"{c}_mean" for c in columns)))
    return reduce(DataFrame.unionByName, out)


def score_bounds(df: DataFrame, scores: str) -> DataFrame:
    """One row: least and largest of an array column's raw scores."""
    each = df.select(F.explode(scores).alias("s"))
    return each.agg(F.min("s").alias("low"), F.max("s").alias("high"))


# ---------------------------------------------------------------- text of a row


def cluster_token(c: Column | str) -> Column:
    """C<number>, or the trimmed text where there is none."""
    n = cluster_number(c)
    text = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.coalesce(F.concat(F.lit("C"), n.cast("string")), text)


def region_in_text(c: Column | str) -> Column:
    """0 to 3 of "C 2" as a word, else of a region's name in the text, else null."""
    x = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    out = F.nullif(F.regexp_extract(x, r"(?i)\bC\s*([0-3])\b", 1), F.lit("")).cast("int")
    for i, name in enumerate(REGIONS):
        out = F.coalesce(out, F.when(F.lower(x).contains(name.lower()), i))
    return out


def nearest_alternative(text: str, cluster: str, weights: Sequence[str]) -> Column:
    """The region a text names, else that of the largest weight but the row's own; the first of equals."""
    pairs = F.array(*(F.when(F.col(cluster).isNull() | (F.col(cluster) != i), F.struct(F.coalesce(F.col(w), F.lit(0.0)).alias("w"), F.lit(-i).alias("i"))) for i, w in enumerate(weights)))
    return F.coalesce(region_in_text(text), -F.array_max(pairs)["i"])


def direction(dv: Column, da: Column) -> Column:
    """Array of the signs that two words stand for: positive or +, negative or -, else 0."""
    one = lambda c: F.when(F.lower(F.trim(c)).isin("positive", "+"), 1.0).when(F.lower(F.trim(c)).isin("negative", "-"), -1.0).otherwise(0.0)
    return F.array(one(dv), one(da))


def issue_flag(*columns: str) -> Column:
    """Any of the flags, whatever form they have."""
    return reduce(lambda a, b: a | b, (F.coalesce(truthy(c), F.lit(False)) for c in columns))


def descriptor_labels(descriptors: Column, limit: int = 5) -> Column:
    """The first descriptors of an array of structs, joined."""
    return F.array_join(F.transform(F.slice(descriptors, 1, limit), lambda d: d["descriptor"]), ", ")


def merge_weights(df: DataFrame, key: str, name: str = "descriptor", weight: str = "weight") -> DataFrame:
    """(key, name, weight): the largest positive finite weight of each name."""
    return df.withColumn(weight, finite(weight)).filter(F.col(weight) > 0).groupBy(key, name).agg(F.max(weight).alias(weight))


def directional_conflict(name: Column, descriptors: Column, directional: Sequence[str]) -> Column:
    """Whether a name of agreeing views stands beside a directional descriptor."""
    return consistent(name) & F.arrays_overlap(descriptors, F.array(*map(F.lit, directional)))


def track_text(title: Column | str, artist: Column | str, identifier: Column | str, lyric: Column | str) -> Column:
    """Artist and title, or what of them and the ids is there."""
    t, a, i, l = (report_text(c) for c in (title, artist, identifier, lyric))
    return F.when((t != "") & (a != ""), F.concat(a, F.lit(" - "), t)).when(t != "", t).when((a != "") & (i != ""), F.concat(a, F.lit(" - "), i)).when(i != "", i).otherwise(l)


def policy_text(policy: Column, weight: Column) -> Column:
    """policy:weight=... in four digits without closing zeros, or the policy alone."""
    digits = F.regexp_replace(F.format_string("%.4g", weight), r"(\.\d*?)0+$", "$1")
    return F.when(weight.isNotNull(), F.concat(policy, F.lit(":weight="), F.rtrim(digits, F.lit(".")))).otherwise(policy)


def label_names(names: Column) -> Column:
    """A map's keys as integers; keys that are none are left out."""
    kept = F.map_filter(names, lambda k, v: k.try_cast("int").isNotNull())
    return F.transform_keys(kept, lambda k, v: k.cast("int"))


def plane_of(source: str) -> list[Column]:
    """The two plane columns for a plot: mean, original or consensus."""
    pairs = {"mean": ("mean_v", "mean_a"), "original": ("ov", "oa"), "consensus": ("bv", "ba")}
    if source not in pairs:
        raise ValueError(f"{source} is none of {list(pairs)}")
    return [F.col(c) for c in pairs[source]]


# ---------------------------------------------------------------- runs


def selected_row(metrics: DataFrame, k: int) -> DataFrame:
    """The row of the selected total K, else of K, else the one of the best score there is, else the first."""
    scores = [c for c in SCORE_ORDER if c in metrics.columns]
    of = lambda c: (finite(c) == k) if c in metrics.columns else F.lit(False)
    ranked = metrics.withColumns({"_total": F.coalesce(of("total_clusters"), F.lit(False)), "_k": F.coalesce(of("k"), F.lit(False)), "_score": finite(scores[0]) if scores else F.lit(None).cast("double"), "_n": F.monotonically_increasing_id()})
    return ranked.orderBy(F.desc("_total"), F.desc("_k"), F.desc_nulls_last("_score"), "_n").limit(1).drop("_total", "_k", "_score", "_n")  # a row a candidate


def score_of(columns: Sequence[str]) -> Column:
    """The first score that isn't null, by priority."""
    there = [finite(c) for c in SCORE_ORDER if c in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


def first_number(df: DataFrame, *columns: str) -> Column:
    """The first of the columns that is there and no null."""
    there = [finite(c) for c in columns if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


def overlap_row(audit: DataFrame) -> DataFrame:
    """The first row of an overlap audit under the names of a summary."""
    first = audit.limit(1)
    return first.select(
        first_number(first, "va_mean_silhouette", "va_silhouette").alias("va_silhouette"), first_number(first, "va_knn_purity_20").alias("knn_purity_20"), first_number(first, "va_center_radius_sep").alias("center_radius_sep"),
        first_number(first, "va_negative_silhouette_fraction").alias("negative_silhouette_fraction"), (truthy("overlap_gate_ok") if "overlap_gate_ok" in first.columns else F.lit(None).cast("boolean")).alias("overlap_gate"),
    )


def run_summary_row(spark: SparkSession, config: str, summary: dict, metrics: DataFrame | None, claim: Column | None = None) -> DataFrame:
    """One row of a run: its choice, scores, gates and policies; status is failed where there is no summary."""
    if not summary:
        return spark.createDataFrame([(config, "failed")], "config string, status string")
    k = int(summary.get("selected_k", -1))
    selection, mask, policy = (summary.get(c) or {} for c in ("selection_info", "mask_purity_diagnostics", "metadata_policy"))
    enrichment = max((float(c.get("enrichment_vs_baseline", 0.0)) for c in mask.get("clusters") or []), default=None)
    row = selected_row(metrics, k) if metrics is not None else spark.createDataFrame([(None,)], "k double")
    number = lambda *c: first_number(row, *c)
    chosen = lambda c: F.coalesce(F.lit(selection.get(c)).cast("double"), number(c))
    told = policy_text(F.lit(policy.get("metadata_policy", "")), F.lit(policy.get("effective_metadata_cluster_weight")).cast("double")) if isinstance(policy, dict) and policy else F.lit(str(policy or "report_only"))
    kept = ["silhouette", "macro_silhouette", "final_silhouette", "affect_weighted_dominant_ratio", "affect_min_dominant_ratio", "affect_mixed_cluster_fraction", "size_balance", "min_cluster_size"]
    return row.select(
        F.lit(config).alias("config"), F.lit("ok").alias("status"), F.lit(k).alias("selected_k"), F.lit(summary.get("k_strategy")).cast("string").alias("k_strategy"), F.lit(summary.get("cluster_feature_strategy")).cast("string").alias("cluster_feature_strategy"),
        score_of(row.columns).alias("score"), (claim if claim is not None else F.lit(None).cast("double")).alias("claim_score"), number("va_mean_silhouette", "va_silhouette", "latent_consensus_silhouette").alias("va_silhouette"),
        number("va_knn_purity_10").alias("knn_purity_10"), number("va_knn_purity_20").alias("knn_purity_20"), number("va_center_radius_sep").alias("center_radius_sep"), number("va_negative_silhouette_fraction").alias("negative_silhouette_fraction"),
        *(number(c).alias(c) for c in kept), *(chosen(c).alias(c) for c in ("seed_ari_mean", "seed_ari_std", "cluster_jaccard_min")),
        F.lit(mask.get("nmi")).cast("double").alias("mask_nmi"), told.alias("metadata_policy"), F.lit(enrichment).cast("double").alias("max_mask_enrichment"), F.lit(bool(selection.get("diagnostic_failed_gate_override", False))).alias("diagnostic_failed_gate_override"),
    )


def compare_runs(left: dict[str, DataFrame], right: dict[str, DataFrame], names: tuple[str, str] = ("Dataset-S", "Dataset-L")) -> dict[str, DataFrame]:
    """alignment of regions by least distance, means of tension tables, and tagged unions of catalogs of two runs."""
    from .audit import align_regions

    spark = next(iter(left.values())).sparkSession
    out: dict[str, DataFrame] = {}
    if "regions" in left and "regions" in right:
        rows = align_regions(left["regions"], right["regions"], x="balanced_valence", y="balanced_arousal")
        out["alignment"] = spark.createDataFrame(rows, "left_id int, right_id int, center_distance double, extra boolean")
    for kind, columns in (("tension", ["size", "mean_tension_norm", "mean_tension_dv", "mean_tension_da"]),):
        if kind in left and kind in right:
            out[kind] = run_means({names[0]: left[kind], names[1]: right[kind]}, columns)
    if "catalog" in left and "catalog" in right:
        out["catalog"] = left["catalog"].withColumn("dataset", F.lit(names[0])).unionByName(right["catalog"].withColumn("dataset", F.lit(names[1])), allowMissingColumns=True)
    return out


def rerun_arguments(config: str, registry: dict[str, dict], common: dict) -> list[str]:
    """The arguments of one configuration's run: its own values over the common ones, flags in order of name."""
    if config not in registry:
        raise ValueError(f"{config} is none of {sorted(registry)}")
    merged = common | registry[config]
    return [x for k in sorted(merged) if merged[k] is not None for x in (f"--{k}", str(merged[k]).lower() if isinstance(merged[k], bool) else str(merged[k]))]
