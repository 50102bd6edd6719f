"""Search for K: candidates begin on a bounded sample, go on over the whole table and are judged there.

The sample is SAMPLE rows at most, by a hash of their keys (a documented bound); it travels to the tasks with the function,
and each candidate and rerun begins in a task of its own. All then go on together over the whole table (whole.py), one job a
step. Sizes, likelihoods, agreement of runs, leaks of masks and quadrants are aggregates over all rows; only what is a metric on
pairs of rows (silhouettes, purities of neighbours) is of the sample. Scores and choices are column expressions over the
rows of metrics.

Balanced regions know no sample: beyond SAMPLE rows all starts are drawn from and fitted to the whole table, silhouettes and
purities are of all its rows, and their centres, radii and neighbours too. Up to SAMPLE rows, tasks hold the whole table.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from ..sources.tables import stored
from . import estimators as E
from . import selection
from . import whole as W
from .grid import nearest
from .neighbors import silhouette
from .whole import Data, Table  # noqa: F401

SAMPLE = 10_000
STRATEGIES = ["composite", "semantic_composite", "macro_micro", "constrained_macro_micro", "macro_only", "latent_va_gmm", "balanced_va_regions", "bic_only", "hierarchical"]


@dataclass(frozen=True)
class Config:
    """What a search is bounded and weighted by."""

    k_min: int = 4
    k_max: int = 24
    starts: int = 10
    least: int = 20
    least_ratio: float = 0.01
    seed: int = 42
    bic: float = 0.30
    silhouette: float = 0.30
    size: float = 0.20
    stability: float = 0.20
    mask: float = 0.15
    runs: int = 5
    sample: int = SAMPLE
    macro_min: int = 4
    macro_max: int = 8
    micro_min: int = 2
    micro_max: int = 5
    affect_gate: bool = False
    affect_level: str = "both"
    least_dominant: float = 0.70
    most_mixed: float = 0.15
    least_weighted: float = 0.80
    least_valid: float = 0.95
    micro_mode: str = "tension_local_consensus"
    micro_tension_weight: float = 1.0
    micro_consensus_weight: float = 1.0
    micro_silhouette: float = 0.0
    micro_effect: float = 0.0
    micro_ratio: float = 1.0
    micro_role: str = "anti_leakage"
    overlap_gate: bool = False
    least_purity: float = 0.90
    least_separation: float = 0.70
    most_negative: float = 0.10
    learn_bias: bool = True
    share_noise: bool = False
    noise_prior: float = 0.0
    latent_steps: int = 100
    diagnostic: bool = False

    def __post_init__(self) -> None:
        if self.k_min < 1 or self.k_max < self.k_min or self.macro_max < self.macro_min or self.least < 1 or not 0 <= self.least_ratio < 1:
            raise ValueError("bounds of K, sizes or ratios are out of order")
        if self.affect_level not in ("macro", "final", "both") or self.micro_role not in ("anti_leakage", "visible_separator"):
            raise ValueError("no such level of the affect gate or role of the consensus")

    def needed(self, rows: int) -> int:
        return selection.size_threshold(rows, self.least, self.least_ratio)


def sampled(df: DataFrame, columns: list[str], limit: int = SAMPLE, key: str = "idx", seed: int = 42) -> pd.DataFrame:
    """At most `limit` rows, the first by a hash of the key and in its order; the limit is the feature."""
    order = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    return df.select(*dict.fromkeys([key, *columns])).orderBy(order, key).limit(limit).toPandas().sort_values(key, kind="stable", ignore_index=True)


def fan_out(spark: SparkSession, jobs: list[dict], run: Callable[[dict], tuple[dict, object]]) -> list[tuple[dict, object]]:
    """run() of each job in a task of its own: (metrics, fitted model) in the order of the jobs."""
    ship(spark)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                metrics, model = run(json.loads(told[i]))
                yield pd.DataFrame({"i": [i], "metrics": [json.dumps(metrics)], "model": [pickle.dumps(model)]})

    told = [json.dumps(j) for j in jobs]
    listed = spark.range(0, len(jobs), 1, max(1, len(jobs)))  # dealt by a hash, several would share a task
    found = listed.mapInPandas(each, "i long, metrics string, model binary").collect()  # a row a candidate
    return [(json.loads(r.metrics), pickle.loads(r.model)) for r in sorted(found, key=lambda r: r.i)]


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    groups = [x[labels == i] for i in np.unique(labels)]
    centres = np.stack([g.mean(0) for g in groups])
    wide = np.array([np.linalg.norm(g - c, axis=1).mean() for g, c in zip(groups, centres)])
    apart = np.sqrt(E.squared(centres, centres))
    np.fill_diagonal(apart, np.inf)
    return float(((wide[:, None] + wide[None, :]) / apart).max(1).mean())


def affect(config: Config, counts: pd.DataFrame, of: Callable[[int], int] = int) -> dict:
    """Quadrants by label, or by what `of` makes of a label."""
    if not config.affect_gate:
        return {}
    told: dict[int, np.ndarray] = {}
    for label, q, n in zip(counts["label"], counts["_q"], counts["n"]):
        if 0 <= q < 4:
            told.setdefault(of(int(label)), np.zeros(4, int))[q] += n
    return E.affect_of_counts(told, int(counts["n"].sum()), config.least_dominant, config.most_mixed, config.least_weighted, config.least_valid)


def mask_leak(counts: pd.DataFrame) -> dict:
    """How much labels tell of which views a row has."""
    if (counts["_pattern"] < 0).all():
        return {"mask_nmi": None, "mask_purity": None}
    table = counts.pivot_table("n", "label", "_pattern", "sum", fill_value=0).to_numpy(float)
    return {"mask_nmi": E.information_of_table(table), "mask_purity": float((table.max(1) / table.sum(1)).max())}


def sizes_of(counts: pd.DataFrame, k: int) -> np.ndarray:
    return np.bincount(counts["label"], counts["n"], k).astype(int)


def validator_of(config: Config) -> E.Validator | None:
    """What micro splits are held to, if anything."""
    final = config.affect_gate and config.affect_level in ("final", "both")
    if not (config.micro_silhouette > 0 or config.micro_effect > 0 or final or config.micro_role == "visible_separator"):
        return None
    bounds = (config.least_dominant, config.most_mixed, config.least_weighted) if final else (None, None, None)
    return E.Validator(config.micro_silhouette, config.micro_effect, config.micro_ratio, config.micro_role, 0.85, 0.60, 0.10, *bounds)


def two_level(data: Data, config: Config, macro: int, least: int, seed: int) -> E.TwoLevel:
    final = config.affect_gate and config.affect_level in ("final", "both")
    model = E.TwoLevel(macro, data.blocks, least, config.micro_min, config.micro_max, config.micro_mode, config.micro_tension_weight, config.micro_consensus_weight, validator_of(config), seed, config.starts)
    return model.fit(data.x, data.seen, data.quadrants if final and data.quadrants is not None else None)


def balanced_partition(x: np.ndarray, k: int, least: int, seed: int, starts: int, most: int) -> E.Partition:
    """estimators.balanced() of rows without hashes."""
    return E.balanced(x, k, least, seed, starts, most)


def begun(data: Data, config: Config, strategy: str, k: int, run: int, size: int) -> W.Model:
    """A candidate's first model, learnt on the sample; a rerun has a seed of its own, one of two levels also rows of its own."""
    seed, n = config.seed if run == 0 else E.seed_of(config.seed, k, run), len(data.x) if data.views is None else data.views.shape[1]
    need = max(1, -(-config.needed(size) * n // max(size, 1)))  # in proportion
    if strategy == "macro_micro":
        if run:
            data, need = data.take(np.repeat(np.arange(n), W.replicate_weights(data.hashes, run).astype(int))), max(1, -(-config.least * n // max(size, 1)))
        return two_level(data, config, k, need, seed)
    if strategy == "latent_va_gmm":
        starts, steps = (config.starts, max(20, config.latent_steps)) if run == 0 else (max(1, min(3, config.starts)), max(20, min(100, config.latent_steps)))
        return E.latent_mixture(data.views, data.view_seen, k, seed, starts, steps, learn_bias=config.learn_bias, share_noise=config.share_noise, prior=config.noise_prior)
    if strategy == "balanced_va_regions":
        return E.balanced(data.x, k, need, seed, config.starts if run == 0 else max(1, min(5, config.starts)), 100, data.hashes)
    if strategy == "hierarchical":
        return E.nested(data.x, range(config.macro_min, config.macro_max + 1), range(config.micro_min, config.micro_max + 1), need, seed, config.starts)
    return E.mixture(data.x, k, data.columns_seen(), seed, config.starts)


def plane(config: Config, data: Data, x: np.ndarray, labels: np.ndarray, known: np.ndarray | None = None) -> dict:
    """Metrics on the plane; `known` are silhouettes by x, which hold there if x is the plane."""
    on = data.plane if data.plane is not None else x[:, :2]
    m = E.plane_metrics(on, labels, config.least_purity, config.least_separation, config.most_negative, known if np.array_equal(on, x) else None)
    names = {"va_knn_purity_10": "purity_10", "va_knn_purity_20": "purity_20", "va_center_radius_sep": "separation", "va_negative_silhouette_fraction": "negative", "va_mean_silhouette": "plane_silhouette", "overlap_gate_ok": "overlap_ok"}
    return {names[k]: (None if isinstance(v, float) and not np.isfinite(v) else v) for k, v in m.items()}


def on_plane(config: Config, data: Data, x: np.ndarray, labels: np.ndarray) -> dict:
    """The mean silhouette by x, and plane()."""
    known = E.silhouettes(x, labels) if len(np.unique(labels)) > 1 and len(x) > 2 else None
    return {"silhouette": 0.0 if known is None else float(known.mean())} | plane(config, data, x, labels, known)


def on_pairs(data: Data, config: Config, strategy: str, model: W.Model) -> dict:
    """Metrics on pairs of rows, of the sample."""
    labels = W.predicted(model, data)
    several = len(np.unique(labels)) > 1
    if strategy == "macro_micro":
        c = data.x[:, slice(*data.blocks[0])]
        out = {"macro_silhouette": E.mean_silhouette(c, model.macro.predict(c)), "final_silhouette": E.mean_silhouette(data.x, labels, E.block_mask(data.seen, len(c), len(data.blocks)), data.blocks)}
        return out | plane(config, data, c, labels)
    if strategy == "latent_va_gmm":
        middle = model.consensus(data.views, data.view_seen)
        return on_plane(config, data, middle, labels)
    if strategy == "balanced_va_regions":
        return on_plane(config, data, data.x, labels)
    return {"silhouette": E.mean_silhouette(data.x, labels, data.seen, data.blocks) if several else None, "davies_bouldin": davies_bouldin(data.x, labels) if several else None}


def spread_of_labels(told: Table, models: list[W.Model], sizes: list[int]) -> list[float]:
    """estimators.centre_separation() on the plane of each model's labels over the whole table: centres by one pass, radii by another."""
    columns = [*W.columns_of(models), *(["_plane"] if "_plane" in told.rows.columns else [])]
    on = lambda data: data.plane if data.plane is not None else data.x[:, :2]

    def sums_of(model: W.Model, k: int) -> Callable[[Data], np.ndarray]:
        def work(data: Data) -> np.ndarray:
            labels = W.predicted(model, data)
            return np.concatenate([np.bincount(labels, minlength=k), *(np.bincount(labels, v, k) for v in on(data).T)])

        return work

    def radii_of(model: W.Model, k: int, centres: np.ndarray) -> Callable[[Data], np.ndarray]:
        def work(data: Data) -> np.ndarray:
            labels = W.predicted(model, data)
            return np.bincount(labels, np.linalg.norm(on(data) - centres[labels], axis=1), k)

        return work

    found = [s.reshape(-1, k) for s, k in zip(W.over_rows(told, [sums_of(m, k) for m, k in zip(models, sizes)], columns=columns), sizes)]
    centres = [(s[1:] / np.maximum(s[0], 1)).T for s in found]
    radii = W.over_rows(told, [radii_of(m, k, c) for m, k, c in zip(models, sizes, centres)], columns=columns)
    return [E.separation_of(list(c[s[0] > 0]), [float(v) for v in (r / np.maximum(s[0], 1))[s[0] > 0]]) for s, c, r in zip(found, centres, radii)]


def on_pairs_of_all(config: Config, told: Table, which: list[int], models: list[W.Model]) -> list[dict]:
    """on_plane() of some models, whose labels are the which-th, over the whole table: silhouettes by boxes, one search for the neighbours of all."""
    first = told.rows.select(F.size("_plane").alias("p"), F.size("_x").alias("x")).first()
    of = lambda c, n: [F.col(c)[i] for i in range(n)]
    plane = of("_plane", first["p"]) if first["p"] > 0 else of("_x", min(2, first["x"]))
    ons, xs, ls = ([f"_{c}{i}" for i in range(n)] for c, n in (("on", len(plane)), ("of", first["x"]), ("label", len(which))))
    rows = stored(told.rows.select("_k", *(c.alias(n) for c, n in zip(plane, ons)), *(c.alias(n) for c, n in zip(of("_x", first["x"]), xs)), *(F.col("labels")[i].alias(n) for i, n in zip(which, ls))), "planes")
    same = len(ons) == len(xs) and rows.filter(" OR ".join(f"NOT {a} <=> {b}" for a, b in zip(ons, xs))).isEmpty()
    found = nearest(rows, rows, ons, 20, "_k", carry=ls).select("_k", "place", *(F.col(n).alias(f"{n}_other") for n in ls))
    met = found.join(rows.select("_k", *ls), "_k")  # every row has as many neighbours
    equal = lambda n: (F.col(n) == F.col(f"{n}_other")).cast("double")
    near = met.agg(*(F.avg(F.when(F.col("place") <= k, equal(n))).alias(f"{n}_{k}") for n in ls for k in (10, 20))).first()
    apart = spread_of_labels(told, models, [len(m.centres) for m in models])
    several = rows.agg(*(F.countDistinct(n).alias(n) for n in ls)).first()

    def mean(columns: list[str], label: str) -> tuple[float, float]:
        each = silhouette(rows, columns, label, "_k")
        return tuple(each.agg(F.avg("silhouette"), F.avg((F.col("silhouette") < 0).cast("double"))).first())

    out = []
    for n, separation in zip(ls, apart):
        if several[n] < 2 or told.size < 3:
            out.append({"silhouette": 0.0} | dict.fromkeys(("purity_10", "purity_20", "separation", "negative", "plane_silhouette")) | {"overlap_ok": False})
            continue
        own = mean(xs, n)
        on, negative = own if same else mean(ons, n)
        ok = near[f"{n}_20"] >= config.least_purity and separation >= config.least_separation and negative <= config.most_negative
        out.append({"silhouette": own[0], "purity_10": near[f"{n}_10"], "purity_20": near[f"{n}_20"], "separation": separation if math.isfinite(separation) else None, "negative": negative, "plane_silhouette": on, "overlap_ok": bool(ok)})
    return out


def on_all(config: Config, strategy: str, k: int, model: W.Model, counts: pd.DataFrame, size: int) -> dict:
    """Sizes, leaks and quadrants of a candidate over the whole table."""
    total, need = len(model.names) if strategy == "macro_micro" else k, config.needed(size)
    sizes = sizes_of(counts, total)
    out = {"k": k, "min_size": int(sizes.min()), "size_needed": need, "size_ok": bool(sizes.min() >= need)}
    if strategy == "macro_micro":
        out |= {"total": total, "total_ok": config.k_min <= total <= config.k_max} | mask_leak(counts)
        if config.affect_gate:
            places = sorted((first, i) for i, first in model.first.items())
            top = affect(config, counts, lambda label: max(i for first, i in places if first <= label))
            last = affect(config, counts)
            ok = {"macro": top["affect_gate_ok"], "final": last["affect_gate_ok"], "both": top["affect_gate_ok"] and last["affect_gate_ok"]}[config.affect_level]
            out |= top | {f"final_{c}": v for c, v in last.items()} | {"macro_affect_gate_ok": top["affect_gate_ok"], "affect_gate_ok": ok}
        return out
    if strategy in ("latent_va_gmm", "balanced_va_regions"):
        return out | {"balance": float(sizes.min() / max(sizes.max(), 1))} | affect(config, counts)
    return out | mask_leak(counts) | affect(config, counts)


def criteria(model: E.Diagonal | E.Latent, told: tuple[float, float, float], size: int) -> dict:
    """Information criteria of a mixture by its log likelihood over the whole table."""
    likelihood, certain, margin = told
    price = math.log(max(size, 2))
    if isinstance(model, E.Latent):
        bic = -2 * likelihood + model.parameters() * price
        return {"bic": bic, "icl": bic - 2 * certain, "margin": margin}
    free = 2 * model.means.size + len(model.weights) - 1
    return {"bic": -2 * likelihood + price * free, "aic": -2 * likelihood + 2 * free}


def stability(strategy: str, tables: list[np.ndarray], runs: int) -> dict:
    """What the contingency tables of a candidate's runs say: of all pairs, or of the base and each rerun."""
    ari = [E.rand_of_table(t) for t in tables]
    if strategy not in ("macro_micro", "latent_va_gmm", "balanced_va_regions"):
        return {"stability": float(np.mean(ari)) if ari else 1.0}
    out = {"ari" if strategy == "balanced_va_regions" else "seed_ari": float(np.mean(ari)) if ari else 1.0, "seed_ari_std": float(np.std(ari)) if ari else 0.0}
    if strategy == "macro_micro":
        met = [E.jaccard_of_table(t) for t in tables]
        out |= {"jaccard_mean": float(np.mean([m for m, _ in met])) if met else 1.0, "jaccard_min": float(min(m for _, m in met)) if met else 1.0, "valid_rate": len(ari) / (runs - 1) if runs > 1 else 1.0}
        if runs > 1 and not ari:
            out |= dict.fromkeys(("seed_ari", "seed_ari_std", "jaccard_mean", "jaccard_min", "valid_rate"), 0.0)
    return out


def balanced_starts(table: Table, config: Config, jobs: list[dict]) -> list[E.Partition]:
    """The balanced regions of each candidate and rerun by all of its starts over the whole table."""
    axes = len(table.rows.select("_x").first()["_x"])
    fits = []
    for job in jobs:
        seed = config.seed if job["run"] == 0 else E.seed_of(config.seed, job["k"], job["run"])
        starts = max(1, config.starts if job["run"] == 0 else min(5, config.starts))
        fits.append(W.Fits(job["k"], [E.seed_of(seed, start) for start in range(starts)], axes))
    return W.balanced(table, fits, config.needed(table.size))


def candidates(spark: SparkSession, table: Table, data: Data | None, strategy: str, config: Config, ks: list[int]) -> list[tuple[dict, W.Model]]:
    """(metrics, model) of each K: begun on some rows, gone on and judged over the whole table; without them (balanced regions), all of it is over the whole table."""
    runs = max(1, config.runs + (strategy == "macro_micro" and config.runs > 1))
    size, jobs = table.size, [{"k": k, "run": run} for k in ks for run in range(runs)]

    def begin(job: dict) -> tuple[dict, W.Model | None]:
        try:
            return job, begun(data, config, strategy, job["k"], job["run"], size)
        except (RuntimeError, ValueError, IndexError) as e:
            if job["run"] == 0 or strategy != "macro_micro":
                raise
            return job | {"failed": str(e)}, None  # a replicate that can't be fitted counts in the valid rate

    found = [(job, m) for job, m in (fan_out(spark, jobs, begin) if data is not None else zip(jobs, balanced_starts(table, config, jobs))) if m is not None]
    models = [m for _, m in found]
    if data is None:
        pass  # they rest
    elif strategy == "balanced_va_regions":
        models = W.priced(table, models, config.needed(table.size))
    else:
        models = W.polished(table, models, [job["run"] or None if strategy == "macro_micro" else None for job, _ in found], tolerance=1e-4 if strategy == "latent_va_gmm" else 1e-3)
    told = W.labelled(table, models)
    counts, at = W.cells(told), {(job["k"], job["run"]): i for i, (job, _) in enumerate(found)}
    wide = [len(m.names) if isinstance(m, E.TwoLevel) else len(m.centres) if isinstance(m, E.Partition) else len(m.weights) for m in models]
    of_base = strategy in ("macro_micro", "latent_va_gmm", "balanced_va_regions")
    pairs = [(k, (at[k, i], at[k, j])) for k in ks for i, j in combinations(range(runs), 2) if (k, i) in at and (k, j) in at and (i == 0 or not of_base)]
    tables = W.agreement(told, [p for _, p in pairs], wide)
    base = [models[at[k, 0]] for k in ks]
    likelihoods = W.certainty(table, base) if isinstance(base[0], (E.Diagonal, E.Latent)) else [None] * len(ks)
    if data is None:
        judged = on_pairs_of_all(config, told, [at[k, 0] for k in ks], base)
    else:
        judged = [m for m, _ in fan_out(spark, [{"i": i} for i in range(len(ks))], lambda job: (on_pairs(data, config, strategy, base[job["i"]]), None))]
    out = []
    for k, model, likely, of_pairs in zip(ks, base, likelihoods, judged):
        metrics = on_all(config, strategy, k, model, counts[at[k, 0]], table.size) | of_pairs | stability(strategy, [t for t, (of, _) in zip(tables, pairs) if of == k], runs)
        metrics |= criteria(model, likely, table.size) if likely else {"inertia": model.inertia} if isinstance(model, E.Partition) else {}
        out.append((metrics, model))
    return out


@dataclass
class Found:
    """The outcome of a search."""

    k: int
    model: object
    metrics: DataFrame
    info: dict = field(default_factory=dict)


_TYPES = {bool: "boolean", int: "long", float: "double", str: "string"}


def as_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small table of metrics; a column without any value is a double."""
    names = list(dict.fromkeys(c for r in rows for c in r))
    kinds = {c: next((_TYPES[type(r[c])] for r in rows if r.get(c) is not None), "double") for c in names}
    values = [tuple(None if r.get(c) is None else float(r[c]) if kinds[c] == "double" else r[c] for c in names) for r in rows]
    return spark.createDataFrame(values, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def gate_info(config: Config, row: dict) -> dict:
    """What the chosen row says of its gates, with the bounds they were held to."""
    if not config.affect_gate:
        return {}
    bounds = {c: getattr(config, c) for c in ("least_dominant", "most_mixed", "least_weighted", "least_valid")}
    return {"affect_gate": True, **bounds, **{k: v for k, v in row.items() if k.startswith(("affect_", "final_affect_", "macro_affect_"))}}


def search(spark: SparkSession, data: Data | Table, strategy: str, config: Config | None = None) -> Found:
    """Fits all candidates of a strategy, scores them and takes one; ValueError where none meets its bounds (a failed job)."""
    config = config or Config()
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy} is none of {STRATEGIES}")
    table = data if isinstance(data, Table) else Table.of(spark, data)
    size = table.size
    if strategy == "balanced_va_regions":
        some = table.held(config.seed) if size <= config.sample else None
    else:
        some = table.sample(config.sample, config.seed)
    if strategy == "hierarchical":
        _, model = fan_out(spark, [{}], lambda job: ({}, begun(some, config, strategy, 0, 0, size)))[0]
        model = W.polished(table, [model])[0]
        sizes = sizes_of(W.cells(W.labelled(table, [model]))[0], len(model.names))
        return Found(len(model.names), model, as_rows(spark, [{"k": len(model.names), "min_size": int(sizes.min())}]), {"strategy": strategy, "label_names": model.names})
    if strategy == "macro_only":
        config, strategy_ = replace(config, micro_min=1, micro_max=1), "macro_micro"
    else:
        strategy_ = "macro_micro" if strategy == "constrained_macro_micro" else strategy
    ks = range(config.macro_min, config.macro_max + 1) if strategy_ == "macro_micro" else range(config.k_min, min(config.k_max, table.size - 1) + 1)
    found = candidates(spark, table, some, strategy_, config, list(ks)) if ks else []
    if not found:
        raise ValueError("no K to try")
    metrics = as_rows(spark, [m for m, _ in found])
    gates = ["size_ok", *(["affect_gate_ok"] if config.affect_gate and strategy_ != "latent_va_gmm" else []), *(["overlap_ok"] if config.overlap_gate and strategy_ not in ("composite", "semantic_composite", "bic_only") else [])]
    eligible = F.lit(True)
    for g in gates:
        eligible = eligible & F.col(g)
    metrics = metrics.withColumn("eligible", eligible)
    if strategy_ == "composite":
        metrics = selection.composite(metrics, config.bic, config.silhouette, config.size, config.stability, config.mask).withColumnRenamed("composite_score", "score")
    elif strategy_ == "semantic_composite":
        metrics = selection.semantic_composite(metrics, config.mask).withColumnRenamed("composite_score", "score")
    elif strategy_ == "macro_micro":
        metrics = metrics.withColumn("score", selection.macro_micro_score(config.overlap_gate))
    elif strategy_ == "latent_va_gmm":
        metrics = metrics.withColumn("score", selection.latent_score())
    elif strategy_ == "balanced_va_regions":
        score = selection.region_score(F.col("silhouette"), F.col("ari"), F.col("balance"), F.col("purity_20"), F.col("separation"), F.col("negative"))
        metrics = metrics.withColumn("score", score)
    else:
        metrics = metrics.withColumn("score", -F.col("bic"))
    if strategy_ == "macro_micro":
        chosen = selection.select_bounded(metrics, "score", gates, "total_ok").first().asDict()
    else:
        chosen = selection.select_k(metrics, "score", "eligible", config.diagnostic, "size_ok").first().asDict()
    told, model = next((m, f) for m, f in found if m["k"] == chosen["k"])
    info = {"strategy": strategy, **chosen, **told, **gate_info(config, told), "config": asdict(config)}
    if "bic" in told:
        info["bic_elbow_k"] = selection.elbow(metrics).first()["k"]
    if chosen.get("gap", 0) and chosen["gap"] > 0.02:
        info["warning"] = "the bounds of total K kept the best candidate out"
    return Found(told.get("total", chosen["k"]), model, metrics, info)


def kmeans_regions(table: Table, k: int, sample: int = SAMPLE, seed: int = 42, starts: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(centres, sizes) of k-means over the whole table, begun on a sample."""
    some = table.sample(sample, seed)
    model = W.priced(table, [E.kmeans(some.x, k, seed, starts)], 0)[0]
    return model.centres, sizes_of(W.cells(W.labelled(table, [model]))[0], k)


def robust_mixture(table: Table, k: int, sample: int = SAMPLE, seed: int = 42, starts: int = 10) -> E.Diagonal:
    """estimators.robust_mixture() that goes on over the whole table; `attempts` tell how it was begun."""
    return W.polished(table, [E.robust_mixture(table.sample(sample, seed).x, k, seed, starts)])[0]


def imputed_mixture(table: Table, k: int, sample: int = SAMPLE, seed: int = 42) -> E.Diagonal:
    """A mixture learnt over the whole table with column means for what is missing; it predicts from what is there alone."""
    ends = table.blocks

    def sums(data: Data) -> np.ndarray:
        seen = data.columns_seen()
        return np.concatenate([(data.x * seen).sum(0), seen.sum(0)])

    total = W.over_rows(table, [sums])[0].reshape(2, -1)
    means = total[0] / np.maximum(total[1], 1)
    seen = [F.col("_seen")[i] for i, (lo, hi) in enumerate(ends) for _ in range(lo, hi)]
    filled = F.array(*(F.when(s, F.col("_x")[j]).otherwise(float(means[j])) for j, s in enumerate(seen)))
    rows = table.rows.withColumns({"_x": filled, "_seen": F.array(*(F.lit(True) for _ in ends))})
    whole = Table(rows, ends, table.size)
    return W.polished(whole, [E.mixture(whole.sample(sample, seed).x, k, seed=seed)])[0]


def alpha_grid(low: float = 0.20, high: float = 0.90, step: float = 0.05) -> list[float]:
    """low, low + step, ... up to high, ten decimals."""
    if step <= 0 or high < low:
        raise ValueError("a grid goes upwards")
    return [round(low + i * step, 10) for i in range(int(round((high - low) / step, 6)) + 1)]


def alpha_candidate(data: Data, alpha: float, k: int, seed: int = 42, price: float = 0.05) -> dict | None:
    """One cell of the search for the views' balance: silhouette, stability and size balance of a mixture of the mixed points."""
    there = data.view_seen[0] | data.view_seen[1]
    a, l = (data.views[i] for i in (0, 1))
    mixed = np.where((data.view_seen[0] & data.view_seen[1])[:, None], alpha * a + (1 - alpha) * l, np.where(data.view_seen[0][:, None], a, l))[there]
    if len(mixed) <= k:
        return None
    labels = E.mixture(mixed, k, seed=E.seed_of(seed, alpha, k), starts=3).predict(mixed)
    sizes = np.bincount(labels, minlength=k)
    if sizes.min() == 0:
        return None
    others = [E.mixture(mixed, k, seed=E.seed_of(seed, alpha, k, run)).predict(mixed) for run in (1, 2, 3)]
    ari = [E.rand_index(labels, o) for o in others if len(np.unique(o)) > 1]
    out = {"alpha": alpha, "k": k, "silhouette": E.mean_silhouette(mixed, labels), "stability": float(np.mean(ari)) if ari else 0.0, "size_balance": float(sizes.min() / sizes.max())}
    return out | {"score": out["silhouette"] + 0.20 * out["stability"] + 0.10 * out["size_balance"] - price * (alpha - 0.5) ** 2}


def learn_alpha(spark: SparkSession, data: Data | Table, alphas: list[float] | None = None, ks: range = range(4, 9), seed: int = 42) -> tuple[float, DataFrame]:
    """(alpha, its best K's row for each alpha): the first of the highest score; 0.5 where too few rows have a view. Of a table, on its sample."""
    data = data.sample(SAMPLE, seed) if isinstance(data, Table) else data
    alphas = alphas or alpha_grid()
    there = int((data.view_seen[0] | data.view_seen[1]).sum())
    cells = [{"alpha": a, "k": k} for a in alphas for k in ks if 2 <= k < there] if there >= max(4, ks.start) else []
    found = [m for m, _ in fan_out(spark, cells, lambda job: ((alpha_candidate(data, job["alpha"], job["k"], seed) or {}), None)) if m] if cells else []
    best: dict[float, dict] = {}
    for m in found:
        if m["alpha"] not in best or m["score"] > best[m["alpha"]]["score"]:
            best[m["alpha"]] = m
    rows = [best[a] for a in sorted(best)]
    if not rows:
        return 0.5, spark.createDataFrame([], "alpha double, k long, silhouette double, stability double, size_balance double, score double")
    return max(rows, key=lambda m: (m["score"], -m["alpha"]))["alpha"], as_rows(spark, rows)


def backend(name: str = "auto", algorithm: str = "gmm") -> str:
    """Which engine fits: there is one; names of others are accepted where it can stand for them, graphics cards are not."""
    if name not in ("auto", "spark", "sklearn", "torch", "cuml"):
        raise ValueError(f"{name} is no backend")
    if algorithm not in ("gmm", "kmeans", "hdbscan", "spectral"):
        raise ValueError(f"{algorithm} is no algorithm")
    if name == "cuml" or algorithm in ("hdbscan", "spectral"):
        raise NotImplementedError(f"{algorithm} on {name} is not built: no graphics card, no density or spectral clustering")
    return "spark"


def fit_predict(x: np.ndarray, algorithm: str, k: int, seed: int = 42, starts: int = 10, name: str = "auto") -> tuple[np.ndarray, object]:
    """(labels, model) of k-means or a mixture on a sample."""
    backend(name, algorithm)
    if algorithm == "kmeans":
        model = E.kmeans(x, k, seed, starts)
        return model.labels, model
    model = E.robust_mixture(x, k, seed, starts)
    return model.predict(x), model
