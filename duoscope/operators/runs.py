"""Whole runs: discovery of regions, profiles of rows in them, and retrieval against declarative queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import interpretation, micro, neighbors, profiles, retrieval, search, statistics, strategies, whole
from ..functions.numeric import quadrant
from ..sources.tables import stored


@dataclass
class RegionRun:
    """The outcome of a discovery run."""

    rows: DataFrame
    found: search.Found
    summary: DataFrame
    probe: DataFrame
    subtypes: DataFrame
    facts: dict


def table_of(features: strategies.Features, key: str = "idx") -> whole.Table:
    """Features with their masks, views, quadrants and mask patterns as rows of arrays, stored."""
    masks = [m.cast("boolean") for m in strategies.block_masks(features.strategy)]
    plane = strategies.primary_plane(features.strategy, features.columns) or [F.col("mean_v"), F.col("mean_a")]
    there = [F.col("has_audio").cast("boolean"), F.col("has_lyrics").cast("boolean")]
    numbers = lambda cs: F.array(*(c.cast("double") for c in cs))
    rows = features.df.select(
        F.col(key).cast("string").alias("_k"), numbers(map(F.col, features.columns)).alias("_x"), F.array(*masks).alias("_seen"), numbers(map(F.col, ("av", "aa", "lv", "la"))).alias("_views"), F.array(*there).alias("_there"),
        numbers(plane).alias("_plane"), quadrant(plane[0], plane[1], there[0] | there[1]).cast("int").alias("_q"), (there[0].cast("int") * 2 + there[1].cast("int")).alias("_pattern"),
    )
    rows = whole.dealt(rows.withColumn("_h", F.xxhash64("_k")))
    return whole.Table(rows, features.blocks, rows.count())


def labels_of(features: strategies.Features, found: search.Found, key: str = "idx") -> DataFrame:
    """All rows with cluster_id, by the model's parameters as column expressions."""
    masks = [m.cast("boolean") for m in strategies.block_masks(features.strategy)]
    views = [[F.col(c).cast("double") for c in names] for names in (("av", "aa"), ("lv", "la"))]
    there = [F.col("has_audio").cast("boolean"), F.col("has_lyrics").cast("boolean")]
    values = [F.col(c).cast("double") for c in features.columns]
    label = whole.label_column(found.model, values, masks, features.blocks, views, there, F.xxhash64(F.col(key).cast("string")))
    return features.df.withColumn("cluster_id", label)


def discover_regions(df: DataFrame, strategy: str = "calibrated_va_tension", k_strategy: str = "balanced_va_regions", config: search.Config | None = None, metadata: Sequence[str] = (), key: str = "idx", alpha: float = 0.5, diff_weight: float = 0.35) -> RegionRun:
    """Features, search, labels of all rows, region summary, gates on the plane and tension subtypes.

    The balanced search works on the strategy's plane; the others on its weighted, scaled features."""
    config = config or search.Config()
    features = strategies.build(df, strategy, metadata, diff_weight=diff_weight, key=key, alpha=alpha)
    plane = strategies.primary_plane(strategy, features.columns)
    if k_strategy == "balanced_va_regions":
        if plane is None:
            raise ValueError(f"{strategy} is on no plane")
        features = strategies.Features(features.df.withColumns({"_f0": plane[0], "_f1": plane[1]}), ["_f0", "_f1"], "mean_va", [1.0, 1.0], [(0, 2)])
    else:
        features = strategies.weighted(strategies.scaled(features))
    features.df = stored(features.df, "features")
    found = search.search(df.sparkSession, table_of(features, key), k_strategy, config)
    labelled = stored(labels_of(features, found, key), "regions")
    consensus = ["mean_v", "mean_a"]
    leak = statistics.mutual_information(labelled.withColumn("_mask", F.concat(F.col("has_audio").cast("int"), F.col("has_lyrics").cast("int"))), "cluster_id", "_mask").first()
    summary = labelled.groupBy("cluster_id").agg(F.count("*").alias("size"), *(F.avg(c).alias(c) for c in consensus))
    sil = neighbors.sampled_silhouette(labelled, consensus, "cluster_id", key).first()
    tension, source = micro.tension_rows(labelled)
    probe, candidates, rows = micro.probe(tension, key=key, seed=config.seed)
    subtypes, rows = micro.substructure(rows, key=key)
    facts = {"selected_k": found.k, "k_strategy": k_strategy, "cluster_feature_strategy": strategy, "mask_nmi": leak["nmi"], "silhouette": sil["silhouette"], "tension_source": source, "rows": labelled.count()}
    return RegionRun(rows, found, summary, probe, subtypes, facts)


def profile_rows(df: DataFrame, key: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(profiles with roles and flags, descriptors) of rows that have their region and tension subtype."""
    flagged = stored(profiles.review_flags(profiles.tension_profiles(profiles.region_profiles(df))), "profiles")
    return flagged, profiles.descriptors(flagged, key)


def interpret_rows(flagged: DataFrame) -> DataFrame:
    """Profiles with all derived interpretation fields, the explanation and eligibility."""
    out = interpretation.interpret(flagged)
    return out.withColumn("explanation", interpretation.explanation()).withColumn("eligible", interpretation.eligible())


def retrieve(interpreted: DataFrame, labels: DataFrame | None = None, ks: Sequence[int] = (5, 10, 20), depth: int = retrieval.DEPTH, key: str = "track_id", queries: DataFrame | None = None) -> dict[str, DataFrame]:
    """rankings of all queries (the built-in ones, or a table of read_queries()) and systems, the pool to be judged, and with labels the metrics and the comparison of systems."""
    rankings = stored(retrieval.top(retrieval.scores(interpreted, queries), depth, key), "rankings")
    out = {"rankings": rankings, "pool": retrieval.pool(rankings, key)}
    if labels is not None:
        out["metrics"] = retrieval.evaluate(rankings, labels, list(ks), key)
        out["systems"] = retrieval.compare_systems(out["metrics"])
    return out


def retrieval_table(features: DataFrame, key: str = "track_id") -> DataFrame:
    """The 24 retrieval features under the names that scores are computed from."""
    names = {"song_id": key, "balanced_valence": "bv", "balanced_arousal": "ba", "tension_dv": "dv", "tension_da": "da", "tension_norm": "norm", "tension_strength_percentile": "tension_percentile", "affective_complexity_score": "complexity"}
    out = features.select(*(F.col(c).alias(names.get(c, c)) for c in features.columns)).withColumns({f"w_{i}": F.col(f"w_region_C{i}") for i in range(4)})
    return out.withColumn("p", F.col("tension_percentile"))


def run_retrieval(interpretation_csv: DataFrame, cluster: DataFrame | None = None, tension: DataFrame | None = None, labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """From three sources to rankings: standard forms, two filling joins, derived fields, scores, pool and metrics."""
    from ..sources.frames import retrieval_features

    features, conflicts = retrieval_features(interpretation_csv, cluster, tension)
    features = stored(features, "retrieval-features")
    return {"features": features, "conflicts": conflicts} | retrieve(retrieval_table(features), labels)
