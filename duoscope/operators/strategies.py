"""Feature strategies for clustering: which columns a strategy takes, their weights, blocks, masks and scaling.

A strategy is a projection of two views, their masks and perhaps metadata, learnt embeddings and gates; what is not
given is derived without a model: the fused embedding is the mean point, gates are uniform. Features are columns f0,
f1, ...; blocks are ranges of them. Principal components come from one aggregate of the covariance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features as G
from .neighbors import impute_unobserved

STRATEGIES = [
    "full", "fused_residual", "fused_only", "fused_va_geometry", "masked_diffaware", "macro_micro_diffaware", "partial_gmm_diffaware", "mean_va", "audio_va", "lyrics_va",
    "balanced_va_diff", "calibrated_va_tension", "latent_two_view_va", "va_geometry", "mean_va_diff", "original_va", "metadata_only", "pca_reduced",
]
DIFFAWARE = ("masked_diffaware", "macro_micro_diffaware", "partial_gmm_diffaware")
ON_PLANE = ("calibrated_va_tension", "balanced_va_diff", "mean_va", "audio_va", "lyrics_va", "va_geometry", "mean_va_diff")
# Policies for metadata, and what marks a metadata feature as affective.
POLICIES = ["all_metadata_upper_bound", "non_affective_metadata", "affective_va_only", "report_only"]
AFFECTIVE_PREFIXES = ["Moods::", "MoodsAll::", "Themes::", "tempo_bin::"]
AFFECTIVE_EXACT = ["numeric::num_MoodsAll", "cross::energy_valence"]
AFFECTIVE_TERMS = ["mood", "theme", "valence", "arousal", "energy", "tempo"]


def base(strategy: str) -> tuple[str, bool]:
    """(strategy without the prefix of reduction, whether it is reduced to principal components)."""
    name = strategy.strip().lower()
    if name.replace("pca_reduced_", "") not in STRATEGIES:
        raise ValueError(f"{strategy} is none of {STRATEGIES}")
    return name.replace("pca_reduced_", ""), name.startswith("pca_reduced")


@dataclass
class Features:
    """A table with feature columns, their weights and blocks."""

    df: DataFrame
    columns: list[str]
    strategy: str
    weights: list[float] = field(default_factory=list)
    blocks: list[tuple[int, int]] = field(default_factory=list)


def raw_embeddings(df: DataFrame, metadata: Sequence[str] = ()) -> DataFrame:
    """df with what a model would give, without one: mean point, fused, view and metadata embeddings, gates of a third each, signed difference."""
    a, l = F.col("has_audio"), F.col("has_lyrics")
    mean = {"mean_v": G.masked_mean(F.col("av"), F.col("lv"), a, l), "mean_a": G.masked_mean(F.col("aa"), F.col("la"), a, l)}
    df = df.withColumns(mean)
    both = a & l
    zero = lambda c: F.when(both, c).otherwise(0.0)
    return df.withColumns({
        "has_metadata": F.col("has_metadata") if "has_metadata" in df.columns else F.lit(bool(metadata)),
        "gate_audio": F.lit(1 / 3), "gate_lyrics": F.lit(1 / 3), "gate_metadata": F.lit(1 / 3),
        "signed_v": zero(F.col("av") - F.col("lv")), "signed_a": zero(F.col("aa") - F.col("la")),
    })


def columns_of(df: DataFrame, strategy: str, metadata: Sequence[str] = (), metadata_weight: float = 1.0, conflict_weight: float = 0.35, gate_weight: float = 0.1, key: str = "idx", alpha: float = 0.5) -> tuple[DataFrame, list[Column]]:
    """(table, feature columns) of a strategy before reduction."""
    name, _ = base(strategy)
    df = raw_embeddings(df, metadata)
    mean = [F.col("mean_v"), F.col("mean_a")]
    view = {"audio": [F.col("av"), F.col("aa")], "lyrics": [F.col("lv"), F.col("la")]}
    there = {"audio": F.col("has_audio"), "lyrics": F.col("has_lyrics")}
    instead = lambda v: [F.when(there[v], x).otherwise(m) for x, m in zip(view[v], mean)]
    meta = [F.when(F.col("has_metadata"), F.col(c)).otherwise(0.0) for c in metadata]
    if name == "mean_va":
        return df, mean
    if name in ("audio_va", "lyrics_va"):
        return df, instead(name.removesuffix("_va"))
    if name == "original_va":
        return df, [F.col("ov"), F.col("oa")]
    if name == "metadata_only":
        return df, meta
    if name == "balanced_va_diff":
        out = G.balanced_difference(df)
        return out, [F.col(c) for c in ("con_v", "con_a", "d_v", "d_a", "gap", "angular_gap", "radial_gap", "agreement")]
    if name == "calibrated_va_tension":
        out = G.tension(df, alpha)
        return out, [F.col(c) for c in ("con_v", "con_a", "ten_v", "ten_a", "ten_norm")]
    if name == "latent_two_view_va":
        filled = [F.when(there[v], x).otherwise(m) for v in ("audio", "lyrics") for x, m in zip(view[v], mean)]
        return df, filled
    if name in DIFFAWARE:
        df = df.withColumn("both", F.col("has_audio") & F.col("has_lyrics"))
        df = impute_unobserved(df, ["mean_v", "mean_a"], ["signed_v", "signed_a"], "both", 5, key)
        return df, [*mean, F.col("signed_v"), F.col("signed_a"), *meta]
    df = conflict_features(df, key)
    conflict = [F.col(c) for c in G.GEOMETRY]
    if name in ("va_geometry", "mean_va_diff"):
        return df, conflict
    if name == "fused_va_geometry":
        return df, [*mean, *conflict]
    gate = [gate_weight * F.col(f"gate_{v}") for v in ("audio", "lyrics", "metadata")]
    told = [conflict_weight * c for c in conflict]
    if name == "fused_only":
        return df, [*mean, *gate, *told]
    audio, lyrics = instead("audio"), instead("lyrics")
    if name == "fused_residual":
        audio, lyrics = ([x - m for x, m in zip(v, mean)] for v in (audio, lyrics))
    return df, [*mean, *audio, *lyrics, *(metadata_weight * m for m in meta), *gate, *told]


def conflict_features(df: DataFrame, key: str = "idx", k: int = 5) -> DataFrame:
    """df with the 14 pairwise features; where a view is missing they are means over the nearest rows that have both."""
    pairs = [c for c in G.GEOMETRY if c not in ("con_v", "con_a")]
    out = G.geometry(df.drop(*(c for c in G.GEOMETRY if c in df.columns)), mask_columns=False).withColumn("both", F.col("has_audio") & F.col("has_lyrics"))
    return impute_unobserved(out, ["con_v", "con_a"], pairs, "both", k, key)


def build(df: DataFrame, strategy: str = "full", metadata: Sequence[str] = (), metadata_weight: float = 1.0, conflict_weight: float = 0.35, gate_weight: float = 0.1, diff_weight: float = 0.35, components: int = 32, key: str = "idx", alpha: float = 0.5) -> Features:
    """The features of any strategy, named f0, f1, ..., with weights and blocks."""
    name, reduced = base(strategy)
    table, columns = columns_of(df, strategy, metadata, metadata_weight, conflict_weight, gate_weight, key, alpha)
    names = [f"f{i}" for i in range(len(columns))]
    table = table.withColumns(dict(zip(names, (c.cast("double") for c in columns))))
    if reduced and components < len(names):
        table, names = principal(table, names, components)
    return Features(table, names, strategy, weights(strategy, len(names), conflict_weight, metadata_weight, diff_weight), block_ranges(strategy, len(names)))


def principal(df: DataFrame, columns: list[str], components: int, prefix: str = "p") -> tuple[DataFrame, list[str]]:
    """(table, names) with the principal components of the columns; means and covariances are one aggregate of D x D numbers."""
    d = len(columns)
    sums = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d))).first()
    spread = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
    value, vector = np.linalg.eigh(spread)
    axes = vector[:, np.argsort(-value)[:components]].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    names = [f"{prefix}{i}" for i in range(len(axes))]
    out = {}
    for name, axis in zip(names, axes):
        total = F.lit(0.0)
        for c, i, w in zip(columns, range(d), axis):
            total = total + (F.col(c) - float(sums[f"m{i}"])) * float(w)
        out[name] = total
    return df.withColumns(out), names


def weights(strategy: str, width: int, conflict: float = 0.35, metadata: float = 1.0, diff: float = 0.35) -> list[float]:
    """One weight a feature."""
    name, _ = base(strategy)
    out = [1.0] * width
    if name in ("va_geometry", "mean_va_diff") and width == 14:
        out = [2.0] * 2 + [conflict] * 12
    elif name == "balanced_va_diff" and width == 8:
        out = [2.5] * 2 + [diff] * 6
    elif name == "calibrated_va_tension" and width >= 5:
        out = [1.0] * 2 + [diff] * (width - 2)
    elif name == "fused_va_geometry" and width > 14:
        out = [0.5] * (width - 14) + [2.0] * 2 + [conflict] * 12
    elif name in DIFFAWARE and width % 3 == 0:
        out = [1.0] * (width // 3) + [diff] * (width // 3) + [metadata] * (width // 3)
    return out


def block_ranges(strategy: str, width: int) -> list[tuple[int, int]]:
    """Ranges of features that are there or missing together."""
    name, _ = base(strategy)
    if name == "balanced_va_diff" and width == 8 or name == "calibrated_va_tension" and width >= 5:
        return [(0, 2), (2, width)]
    if name == "latent_two_view_va" and width == 4:
        return [(0, 2), (2, 4)]
    if name in DIFFAWARE and width % 3 == 0:
        return [(i * width // 3, (i + 1) * width // 3) for i in range(3)]
    return [(0, width)]


def block_masks(strategy: str) -> list[Column]:
    """Which blocks a row shows; a row that shows none is taken to show the first."""
    name, _ = base(strategy)
    a, l = F.col("has_audio"), F.col("has_lyrics")
    if name == "latent_two_view_va":
        masks = [a, l]
    elif name in ("balanced_va_diff", "calibrated_va_tension"):
        masks = [a | l, a & l]
    elif name in DIFFAWARE:
        masks = [a | l | F.col("has_metadata"), a & l, F.col("has_metadata")]
    else:
        return [F.lit(True)]
    return never_empty(masks)


def never_empty(masks: list[Column]) -> list[Column]:
    """Masks of which the first holds where no other does."""
    any_ = masks[0]
    for m in masks[1:]:
        any_ = any_ | m
    return [masks[0] | ~any_, *masks[1:]]


def without_blocks(masks: list[Column], diff_weight: float = 1.0, metadata_weight: float = 1.0) -> list[Column]:
    """Masks with the difference or metadata block turned off where its weight is not positive."""
    off = {i for i, w in ((1, diff_weight), (2, metadata_weight)) if w <= 0 and i < len(masks)}
    return never_empty([F.lit(False) if i in off else m for i, m in enumerate(masks)]) if off else masks


def feature_masks(masks: list[Column], blocks: Sequence[tuple[int, int]]) -> list[Column]:
    """One mask a feature, by its block."""
    return [m for m, (lo, hi) in zip(masks, blocks) for _ in range(hi - lo)]


def primary_plane(strategy: str, columns: Sequence[str]) -> list[Column] | None:
    """The two columns of the region plane, or None for a strategy that is on no plane."""
    name, _ = base(strategy)
    if name == "latent_two_view_va" and len(columns) >= 4:
        return [(F.col(columns[i]) + F.col(columns[i + 2])) / 2 for i in (0, 1)]
    return [F.col(c) for c in columns[:2]] if name in ON_PLANE and len(columns) >= 2 else None


def weighted(of: Features) -> Features:
    """Features times their weights."""
    if len(of.weights) != len(of.columns):
        raise ValueError(f"{len(of.weights)} weights for {len(of.columns)} features")
    return Features(of.df.withColumns({c: F.col(c) * float(w) for c, w in zip(of.columns, of.weights)}), of.columns, of.strategy, of.weights, of.blocks)


def block_statistics(df: DataFrame, columns: Sequence[str], masks: list[Column], blocks: Sequence[tuple[int, int]], fit: Column | None = None) -> DataFrame:
    """One row: mean, population deviation and number of observed rows of each column, by its block's mask."""
    out = []
    for c, m in zip(columns, feature_masks(masks, blocks)):
        x = F.when(m & fit if fit is not None else m, F.col(c))
        out += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_sd"), F.count(x).alias(f"{c}_n")]
    return df.agg(*out)


def scaled(of: Features, mode: str = "auto", fit: Column | None = None) -> Features:
    """z-scores: by observed blocks (others 0) or over all rows; the latent strategy stays as it is."""
    name, _ = base(of.strategy)
    if mode not in ("auto", "standard", "observed"):
        raise ValueError("a scaler is auto, standard or observed")
    if name == "latent_two_view_va":
        return of
    by_block = len(of.blocks) > 1 and (mode == "observed" or mode == "auto" and name in DIFFAWARE)
    masks = block_masks(of.strategy) if by_block else [F.lit(True)] * len(of.blocks)
    table = of.df.crossJoin(F.broadcast(block_statistics(of.df, of.columns, masks, of.blocks, fit)))  # one row
    z = {c: F.when(m, (F.col(c) - F.coalesce(f"{c}_mean", F.lit(0.0))) / F.when(F.col(f"{c}_sd") > 1e-6, F.col(f"{c}_sd")).otherwise(1.0)).otherwise(0.0) for c, m in zip(of.columns, feature_masks(masks, of.blocks))}
    return Features(table.withColumns(z).drop(*(f"{c}_{s}" for c in of.columns for s in ("mean", "sd", "n"))), of.columns, of.strategy, of.weights, of.blocks)


def affective(name: Column) -> Column:
    """Whether a metadata feature tells of affect: by its whole name, its field or a term in it."""
    out = name.isin(AFFECTIVE_EXACT)
    for prefix in AFFECTIVE_PREFIXES:
        out = out | name.startswith(prefix)
    for term in AFFECTIVE_TERMS:
        out = out | F.lower(name).contains(term)
    return out


def metadata_policy(policy: str, names: DataFrame, weight: float, feature: str = "feature") -> dict:
    """What a policy makes of the metadata weight; ValueError for an unknown one, or for affective features where they are ruled out."""
    asked = (policy or POLICIES[0]).strip().lower()
    if asked not in POLICIES:
        raise ValueError(f"{policy} is none of {POLICIES}")
    found = [r[0] for r in names.filter(affective(F.col(feature))).select(feature).orderBy(feature).limit(13).collect()]  # examples
    effective = "affective_va_only" if asked == "report_only" else asked
    if effective == "non_affective_metadata" and found:
        raise ValueError(f"the metadata has affective features, such as {', '.join(found[:8])}")
    requested = 0.0 if asked == "report_only" else weight
    used = 0.0 if effective == "affective_va_only" else requested
    return {"policy": asked, "effective_policy": effective, "input_weight": weight, "requested_weight": requested, "effective_weight": used, "used_for_clustering": used > 0, "affective_examples": found[:12]}
