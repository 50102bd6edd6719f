"""Gates over a finished run's tables: each is a row (gate, status, value, detail); the run is ready if none fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(name: str, ok: Column, value: Column, soft: bool = False, detail: str = "") -> Column:
    status = F.when(ok.isNull(), "missing").when(ok, "pass").otherwise("warn" if soft else "fail")
    return F.struct(F.lit(name).alias("gate"), status.alias("status"), value.cast("double").alias("value"), F.lit(detail).alias("detail"))


def overlap_gates(metrics: DataFrame) -> DataFrame:
    """metrics: one row (purity_20, separation, negative_fraction, seed_ari, min_size_ok)."""
    gates = F.array(
        gate("overlap", (F.col("purity_20") >= 0.88) & (F.col("separation") >= 0.70) & (F.col("negative_fraction") <= 0.05), F.col("purity_20")),
        gate("seed_stability", F.col("seed_ari") >= 0.90, F.col("seed_ari")),
        gate("min_size", F.col("min_size_ok"), F.col("min_size_ok").cast("double")),
        gate("affect_purity", F.col("affect_purity") >= 0.70, F.col("affect_purity"), soft=True),
    )
    return metrics.select(F.explode(gates).alias("g")).select("g.*")


def ready(gates: DataFrame) -> DataFrame:
    return gates.agg((F.count_if(F.col("status") == "fail") == 0).alias("ready"), F.count_if(F.col("status") == "fail").alias("failures"), F.count_if(F.col("status") == "warn").alias("warnings"))


def split_consistency(df: DataFrame, split: str, cluster: str, quadrant: str) -> DataFrame:
    """Share of (split, cluster) whose dominant quadrant is that of all rows."""
    def dominant(keys: list[str]) -> DataFrame:
        n = df.groupBy(*keys, quadrant).count()
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), quadrant))
        return n.withColumn("_p", first).filter("_p = 1").select(*keys, quadrant)

    whole = dominant([cluster]).withColumnRenamed(quadrant, "whole")
    met = dominant([split, cluster]).join(whole, cluster, "left")
    return met.agg(F.avg((F.col(quadrant) == F.col("whole")).cast("double")).alias("share"))


def count_reproduced(counts: DataFrame) -> DataFrame:
    """counts (cluster, n_split, n_all): whether they differ by at most a quarter, or by one."""
    near = F.abs(F.col("n_split") - F.col("n_all")) <= F.greatest(F.lit(1.0), F.round(0.25 * F.greatest("n_all", F.lit(1))))
    return counts.withColumn("ok", near)


def missing_configs(present: DataFrame, required: DataFrame, name: str = "name") -> DataFrame:
    return required.select(name).subtract(present.select(name))


def affect_penalty(weighted: Column, mixed: Column, least: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, 0.80 - weighted) + F.greatest(zero, mixed - 0.15) + F.greatest(zero, 0.70 - least)


def claim_score(separation: Column, nmi: Column, enrichment: Column, penalty: Column) -> Column:
    zero = F.lit(0.0)
    return separation - F.greatest(zero, nmi - 0.05) - 0.05 * F.greatest(zero, enrichment - 1.3) - penalty


def ablation_deltas(configs: DataFrame, main: str, columns: list[str], name: str = "config") -> DataFrame:
    """Each configuration's metrics less the main one's; the main row is broadcast."""
    base = configs.filter(F.col(name) == main).select(*(F.col(c).alias(f"_{c}") for c in columns)).limit(1)
    out = configs.crossJoin(F.broadcast(base))
    return out.select(*configs.columns, *((F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in columns))


def align_regions(left: DataFrame, right: DataFrame, k: str = "cluster_id", x: str = "bv", y: str = "ba") -> list[tuple[int, int, float, bool]]:
    """(left, right, distance, extra): least-cost pairs of two runs' region centres; leftovers go to the nearest.

    Centres are a row a region, so they may be collected."""
    import numpy as np

    from .clustering import hungarian

    a, b = ([(r[k], r[x], r[y]) for r in df.orderBy(k).collect()] for df in (left, right))
    swap = len(a) > len(b)
    small, large = (b, a) if swap else (a, b)
    cost = np.array([[((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 for q in large] for p in small])
    chosen = hungarian(cost)
    out = [(small[i][0], large[j][0], float(cost[i, j]), False) for i, j in enumerate(chosen)]
    out += [(small[int(cost[:, j].argmin())][0], large[j][0], float(cost[:, j].min()), True) for j in range(len(large)) if j not in chosen]
    return sorted(((q, p, d, e) if swap else (p, q, d, e)) for p, q, d, e in out)


# ---------------------------------------------------------------- all gates of a run

# Bounds of the gates.
MASK_NMI, ENRICHMENT, SEED_ARI = 0.05, 1.30, 0.90
SPLITS = ["train", "val", "test", "all"]
DONE = ["ok", "pass", "success", "completed"]


def verdict(name: str, ok: bool | None, detail: str = "", soft: bool = False, value: float | None = None) -> tuple:
    return name, "missing" if ok is None else "pass" if ok else "warn" if soft else "fail", None if value is None else float(value), detail


def mask_enrichment(diagnostics: DataFrame, value: str = "enrichment") -> DataFrame:
    """One row: the largest enrichment of a mask pattern over clusters."""
    return diagnostics.agg(F.max(value).alias("max_enrichment"))


def overlap_ok(row: str = "") -> Column:
    """Whether a split's overlap is accepted: its own gate, or purity, separation and negative share within bounds."""
    c = lambda n: F.col(f"{row}{n}")
    return F.coalesce(c("overlap_gate_ok"), F.lit(False)) | ((c("va_knn_purity_20") >= 0.88) & (c("va_center_radius_sep") >= 0.70) & (c("va_negative_silhouette_fraction") <= 0.05))


def metadata_unused(policy: Column, weight: Column, used: Column) -> Column:
    return (F.lower(policy) == "report_only") & (weight == 0) & ~F.coalesce(used, weight > 0)


def residual_only(probe: DataFrame, source: str = "tension_micro_source") -> DataFrame:
    """One row: whether every probe row comes from residual tension (an empty table does)."""
    return probe.agg((F.count_if(F.lower(F.col(source)) != "residualized") == 0).alias("ok"))


def ablation_coverage(baseline: DataFrame, ablation: DataFrame, required: list[str], main: str, score: str = "claim_score") -> DataFrame:
    """One row: missing and failed configurations, the main one's score, and those not below it (a context, no failure)."""
    names = baseline.select("config").union(ablation.select("config")).distinct()
    wanted = baseline.sparkSession.createDataFrame([(c,) for c in required], "config string")
    missing = wanted.subtract(names).agg(F.sort_array(F.collect_list("config")).alias("missing"))
    failed = baseline.filter(F.col("config").isin(required) & ~F.lower("status").isin(DONE)).agg(F.sort_array(F.collect_list("config")).alias("failed"))
    own = baseline.filter(F.col("config") == main).agg(F.max(score).alias("main_score"))
    beaten = baseline.filter(F.col("config") != main).crossJoin(F.broadcast(own)).filter(F.col(score) >= F.col("main_score")).agg(F.sort_array(F.collect_list("config")).alias("not_improved"))
    out = missing.crossJoin(failed).crossJoin(own).crossJoin(beaten)  # one row each
    return out.withColumn("ok", (F.size("missing") == 0) & (F.size("failed") == 0) & F.col("main_score").isNotNull())


def audit_run(spark, summary: dict, metrics: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, present: dict[str, bool] | None = None, required: list[str] | None = None, main: str = "full") -> DataFrame:
    """(gate, status, value, detail): the seventeen gates of a run.

    tables may hold overlap_<split>, probe_<split>, baseline and ablation; present says which artifacts are there. All
    tables are a row a cluster or a configuration, so single values of them reach the driver."""
    from .reports import selected_row

    tables, present = tables or {}, present or {}
    selection = summary.get("selection_info") or {}
    mode = str(summary.get("selection_mode", selection.get("selection_mode", ""))).lower()
    balanced, k = mode == "balanced_va_regions", int(summary.get("selected_k", selection.get("selected_k", -1)))
    row = selected_row(metrics, k).first() if metrics is not None else None
    row = row.asDict() if row else {}
    out = []
    bound = row.get("total_k_ok", row.get("min_size_ok"))
    out.append(verdict("total_k_constraint_honored", None if bound is None and not row else str(bound).lower() == "true", value=k))
    needed = ["seed_ari_mean", "seed_ari_std"] if balanced else ["seed_ari_mean", "cluster_jaccard_min", "bootstrap_valid_rate"] if "macro_micro" in mode else ["stability"]
    out.append(verdict("bootstrap_stability_present", all(c in selection for c in needed) or all(c in row for c in needed)))
    mask = summary.get("mask_purity_diagnostics") or {}
    nmi = mask.get("nmi")
    out.append(verdict("mask_nmi_below_0_05", nmi is not None and nmi < MASK_NMI, value=nmi))
    most = max((float(c.get("enrichment_vs_baseline", 0.0)) for c in mask.get("clusters") or []), default=None)
    out.append(verdict("max_mask_enrichment_below_1_30", most is not None and most <= ENRICHMENT, soft=True, value=most))
    out.append(verdict("macro_micro_artifacts_present", "macro_micro" not in mode or bool(present.get("macro_micro"))))
    share = summary.get("split_semantic_consistency")
    out.append(verdict("split_semantic_consistency_quantified", "macro_micro" not in mode or share is not None, value=share))
    mean, wide = (selection.get(c, row.get(c)) for c in ("seed_ari_mean", "seed_ari_std"))
    out.append(verdict("balanced_va_region_stability_present", not balanced or (mean is not None and wide is not None and float(mean) >= SEED_ARI), value=mean))
    gone = [s for s in SPLITS if f"overlap_{s}" not in tables] if balanced else []
    bad = [] if gone or not balanced else [s for s in SPLITS if not (r := tables[f"overlap_{s}"].limit(1).select(overlap_ok().alias("ok")).first()) or not r["ok"]]
    out.append(verdict("overlap_gate_train_val_test_all", not gone and not bad, ",".join(gone or bad)))
    policy = summary.get("metadata_policy") or selection.get("metadata_policy") or {}
    told = policy if isinstance(policy, dict) else {"metadata_policy": policy, "effective_metadata_cluster_weight": 0.0}
    weight = float(told.get("effective_metadata_cluster_weight", 0.0))
    unused = str(told.get("metadata_policy", "")).lower() == "report_only" and weight == 0 and not told.get("metadata_block_used_for_clustering", weight > 0)
    out.append(verdict("metadata_not_used_for_clustering", unused, value=weight))
    sources = {s: bool(tables[f"probe_{s}"].columns.count("tension_micro_source")) and residual_only(tables[f"probe_{s}"]).first()["ok"] for s in SPLITS if f"probe_{s}" in tables}
    out.append(verdict("report_only_tension_present", not balanced or bool(present.get("tension") and sources.get("all"))))
    ok, soft = not balanced, False
    if balanced and len(sources) == len(SPLITS) and all(sources.values()):
        split = {s: tables[f"probe_{s}"].agg(F.count_if(F.col("selected_micro_k") > 1).alias("n")).first()["n"] for s in SPLITS}
        ok, soft = all(abs(split[s] - split["all"]) <= max(1, round(0.25 * max(split["all"], 1))) for s in SPLITS[:3]), True
    out.append(verdict("tension_split_reproducibility", ok, soft=soft))
    out.append(verdict("alpha_search_report_present", not balanced or bool(present.get("alpha"))))
    pure = row.get("affect_gate_ok", summary.get("affect_gate_ok"))
    out.append(verdict("affect_purity_gate", str(pure).lower() == "true", soft=balanced, value=row.get("affect_weighted_dominant_ratio") and float(row["affect_weighted_dominant_ratio"])))
    if "baseline" in tables and "ablation" in tables:
        c = ablation_coverage(tables["baseline"], tables["ablation"], required or [], main).first()
        out.append(verdict("required_ablations_present", c["ok"], ",".join([*c["missing"], *c["failed"]]), value=c["main_score"]))
    else:
        out.append(verdict("required_ablations_present", False, "no reports"))
    head = int(summary.get("cluster_head_k", selection.get("cluster_head_k", 0)) or 0)
    out.append(verdict("random_cluster_head_disabled", head == 0, value=head))
    out.append(verdict("metadata_policy_declared", bool(policy)))
    both = summary.get("require_both_va", (summary.get("dataset_filter_summary") or {}).get("require_both_va", False))
    out.append(verdict("complete_audio_lyrics_va_subset", bool(both)))
    return spark.createDataFrame(out, "gate string, status string, value double, detail string")
