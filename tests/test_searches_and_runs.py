"""Estimators, searches, subtypes, strategies, losses and whole runs on closed-form fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.operators import audit, dataset, micro, neighbors, reports, runs, search, selection, strategies, training
from duoscope.operators import estimators as E
from duoscope.plans.adapters import tracks

SF = "/root/testdata/sf0.001"


def blobs(n=60, wide=0.04, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, wide, (n, 2)) for c in ((0.24, 0.25), (0.26, 0.76), (0.76, 0.25), (0.78, 0.76))])
    return x, np.repeat(np.arange(4), n)


def test_agreement_and_separation():
    a = np.array([0, 0, 1, 1])
    assert E.rand_index(a, 1 - a) == 1 and E.rand_index(a, np.array([0, 1, 0, 1])) == pytest.approx(-0.5) and E.rand_index(a * 0, a * 0) == 1
    assert E.jaccard_summary(a, np.array([0, 0, 0, 1])) == (pytest.approx((2 / 3 + 0.5) / 2), 0.5)
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1]])
    s = E.silhouettes(x, a)
    assert s[0] == pytest.approx(1 - 1 / ((10 + math.sqrt(101)) / 2)) and E.knn_purity(x, a, 1) == 1 and E.centre_separation(x, a) == 10
    assert E.mean_silhouette(x, a * 0) == 0 and E.effect_size(x[:2], a[:2]) == 0 and math.isnan(E.plane_metrics(x, a * 0)["va_knn_purity_20"])
    m = E.affect_metrics(np.array([0] * 4 + [1] * 4), np.array([0, 0, 1, 1, 1, 1, 1, 1]), 0.70, 0.15, 0.80)
    assert (m["affect_min_dominant_ratio"], m["affect_weighted_dominant_ratio"], m["affect_mixed_cluster_fraction"], m["affect_gate_ok"]) == (0.5, 0.75, 0.5, False)
    assert E.log_sum_exp(np.array([[1000.0, 1000.0], [-np.inf, -np.inf]])).tolist() == [1000 + math.log(2), -np.inf]


def test_masked_distances_by_hand():
    x, seen = np.array([[0.0, 0, 5], [3, 4, 1], [1, 1, 2]]), np.array([[1, 1], [1, 0], [0, 1]], bool)
    d = E.masked_distances(x, seen, [(0, 2), (2, 3)])
    assert d[0, 1] == pytest.approx(math.sqrt(25 / 2 * 3)) and d[0, 2] == pytest.approx(math.sqrt(9 * 3)) and d[1, 2] == max(d[0, 1], d[0, 2]) and (np.diag(d) == 0).all()


def test_estimators_find_blobs():
    x, y = blobs()
    assert E.rand_index(E.kmeans(x, 4).labels, y) == 1 and E.rand_index(E.robust_mixture(x, 4).predict(x), y) == 1
    holes = np.ones(x.shape, bool)
    holes[::5, 1] = False
    assert E.rand_index(E.mixture(x, 4, holes, starts=5).predict(x, holes), y) > 0.7 and E.rand_index(E.imputed_mixture(x, 4, holes, starts=5).predict(x, holes), y) > 0.6
    assert len(E.robust_mixture(x, 4, most=1, tolerance=0.0).attempts) > 1
    labels, names = E.hierarchical(x, range(2, 5), range(2, 4), 20)
    assert len(names) == len(set(labels.tolist())) and np.bincount(labels).min() >= 20


def test_latent_mixture_learns_bias_and_missing_views():
    x, y = blobs(50)
    rng = np.random.default_rng(1)
    views = np.stack([x + [0.05, 0.0] + rng.normal(0, 0.02, x.shape), x - [0.05, 0.0] + rng.normal(0, 0.06, x.shape)])
    seen = np.ones((2, len(x)), bool)
    m = E.latent_mixture(views, seen, 4)
    assert E.rand_index(m.predict(views, seen), y) == 1 and m.bias[0, :, 0].mean() == pytest.approx(0.05, abs=0.01)
    assert np.abs(m.tension(views, seen)).mean() < np.abs(views[1] - views[0]).mean() and m.icl(views, seen) >= m.bic(views, seen)
    assert np.allclose(m.reliability().sum(0), 1) and m.parameters() == 3 + 8 + 8 + 8 + 16
    seen[0, ::3] = False
    again = E.latent_mixture(views, seen, 4)
    assert E.rand_index(again.predict(views, seen), y) > 0.9 and (again.tension(views, seen)[::3] == 0).all()
    with pytest.raises(ValueError):
        E.latent_mixture(views, seen & False, 2)


def test_two_levels_and_their_validator():
    x, _ = blobs(40)
    side = np.where(np.arange(len(x)) % 2, 1.0, -1.0)[:, None]
    f = np.hstack([x, side + np.random.default_rng(0).normal(0, 0.1, (len(x), 2))])
    model = E.TwoLevel(4, [(0, 2), (2, 4)], least=10, micro_min=2, micro_max=3, starts=2).fit(f)
    assert sorted(model.names) == sorted(f"M{i}-{c}" for i in range(1, 5) for c in "ab") and (model.predict(f) == model.labels).all()
    none = E.TwoLevel(4, [(0, 2), (2, 4)], least=100, starts=2).fit(f)
    assert none.names == ["M1", "M2", "M3", "M4"] and none.details[0][1]["status"] == "not_evaluated_size_cap"
    strict = E.TwoLevel(4, [(0, 2), (2, 4)], least=10, micro_min=2, micro_max=2, starts=2, validator=E.Validator(0.0, 1e6, 10.0)).fit(f)
    assert strict.names == none.names and "tension_effect" in strict.details[0][1]["reason"]
    with pytest.raises(ValueError):
        E.Validator(role="x").reasons(np.array([0, 1]), f[:2, :2], f[:2, 2:], 1.0)
    mask = np.zeros((3, 2), bool)
    assert E.block_mask(mask, 3, 2).tolist() == [[True, False]] * 3
    with pytest.raises(ValueError):
        E.block_mask(mask, 2, 2)


def test_tension_probe_rejects_what_has_no_direction():
    rng = np.random.default_rng(0)
    norm_only = np.column_stack([np.zeros(80), np.zeros(80), rng.random(80)])
    assert E.probe_tension(norm_only, 0, micro._name)[0]["status"] == "no_signed_tension_variation"
    small = np.column_stack([np.repeat([0.01, -0.01], 40), np.zeros(80), np.full(80, 0.01)])
    summary, told, labels = E.probe_tension(small, 0, micro._name)
    assert summary["status"] == "fallback" and "directional_subtypes_not_distinct" in told[0]["reason"] and not labels.any()
    assert E.probe_tension(small[:10], 0, micro._name)[0]["status"] == "not_enough_observed_pairs"
    wide = np.column_stack([np.repeat([0.4, -0.4], 40) + rng.normal(0, 0.02, 80), rng.normal(0, 0.02, 80), np.full(80, 0.4)])
    summary, _, labels = E.probe_tension(wide, 0, micro._name)
    assert summary["status"] == "accepted" and summary["selected_micro_k"] == 2 and np.bincount(labels).tolist() == [40, 40]


def test_subtype_names_agree_with_columns(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, r)) for r in np.column_stack([rng.uniform(-0.2, 0.2, (60, 2)), rng.uniform(0, 0.3, 60)])]
    got = [r[0] for r in spark.createDataFrame(rows, "x double, y double, n double").select(selection.subtype_name(F.col("x"), F.col("y"), F.col("n"))).collect()]
    assert got == [micro._name(*r) for r in rows]


def test_labels_of_the_probe_are_the_estimators(spark):
    rng = np.random.default_rng(5)
    d = np.repeat([[0.4, 0.0], [-0.4, 0.1]], 60, 0) + rng.normal(0, 0.03, (120, 2))
    rows = [(i, 0, float(a), float(b), float(math.hypot(a, b)), i % 10 != 0) for i, (a, b) in enumerate(d)]
    df = spark.createDataFrame(rows, "idx long, cluster_id int, t_dv double, t_da double, t_norm double, pair_seen boolean")
    summary, _, labelled = micro.probe(df)
    got = {r.idx: r.micro_id for r in labelled.collect()}
    assert summary.first().selected_micro_k == 2 and all((got[i] == -1) == (i % 10 == 0) for i in got)
    assert len({got[i] for i in range(1, 60) if i % 10}) == 1 and len({got[i] for i in range(61, 120) if i % 10}) == 1
    groups, named = micro.substructure(labelled)
    for r in groups.collect():
        assert r.t_dv_low <= r.mean_dv <= r.t_dv_high and r.t_dv_high - r.t_dv_low < 0.05
    assert named.filter("micro_id = -1 and subtype_label = ''").count() == 12


def test_searches_choose_the_blobs(spark):
    x, y = blobs(30)
    config = search.Config(k_min=2, k_max=5, least=10, runs=3, starts=3, macro_min=3, macro_max=4)
    data = search.Data(x, np.ones((len(x), 1), bool), [(0, 2)], np.stack([x, x + 0.01]), np.ones((2, len(x)), bool), y % 4, np.zeros(len(x), int), x)
    for strategy in ("composite", "semantic_composite", "balanced_va_regions", "latent_va_gmm"):
        found = search.search(spark, data, strategy, config)
        assert found.k == 4 and found.info["strategy"] == strategy, (strategy, found.info)
    assert search.search(spark, data, "bic_only", config).k >= 4 and search.search(spark, data, "hierarchical", config).k >= 3
    f = search.Data(np.hstack([x, np.zeros((len(x), 2))]), np.ones((len(x), 2), bool), [(0, 2), (2, 4)], quadrants=y)
    found = search.search(spark, f, "macro_only", config)
    assert found.k == 4 and found.info["seed_ari"] > 0.9
    with pytest.raises(Exception, match="meets the bounds"):
        search.search(spark, data, "composite", search.Config(k_min=2, k_max=3, least=1000, runs=1, starts=1))
    assert search.search(spark, data, "composite", search.Config(k_min=2, k_max=3, least=1000, runs=1, starts=1, diagnostic=True)).info["overridden"]
    with pytest.raises(ValueError):
        search.search(spark, data, "other")
    alpha, scores = search.learn_alpha(spark, data, [0.3, 0.5], range(4, 5))
    assert alpha in (0.3, 0.5) and scores.count() == 2
    with pytest.raises(NotImplementedError):
        search.fit_predict(x, "hdbscan", 3)
    for bad in ({"k_min": 5, "k_max": 4}, {"affect_level": "x"}):
        with pytest.raises(ValueError):
            search.Config(**bad)


def test_balanced_partition_keeps_sizes():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.045, (n, 2)) for c, n in (((0.24, 0.25), 70), ((0.26, 0.76), 70), ((0.76, 0.25), 70), ((0.78, 0.76), 20))])
    p = search.balanced_partition(x, 4, 50, 0, 3, 100)
    assert np.bincount(p.labels, minlength=4).min() >= 50


def test_elbow_and_choice(spark):
    m = spark.createDataFrame([(2, 10.0, True), (3, 4.0, False), (4, 3.0, False), (5, 2.5, False)], "k int, bic double, ok boolean")
    assert selection.elbow(m).first().k == 3 and selection.elbow(m.filter("k < 4")).first().k == 3 and selection.elbow(m.filter("k in (2, 5)")).first().k == 5
    assert selection.select_k(m, "bic", "ok").first().k == 2
    with pytest.raises(Exception, match="meets the bounds"):
        selection.select_k(m.filter("k > 2"), "bic", "ok").collect()
    assert tuple(selection.select_k(m.filter("k > 2"), "bic", "ok", diagnostic=True).first()) == (3, 4.0, True)


def test_every_strategy_builds_and_scales(spark):
    t = tracks(spark, SF).filter("idx < 60").withColumns({"m0": F.col("ov"), "m1": F.col("oa")})
    for name in strategies.STRATEGIES:
        of = strategies.build(t, name, ["m0", "m1"], components=3)
        rows = strategies.scaled(strategies.weighted(of)).df.select(*of.columns).collect()
        assert len(rows) == 60 and all(v is not None and math.isfinite(v) for r in rows for v in r), name
        assert of.blocks[-1][1] == len(of.columns) == len(of.weights)
    assert len(strategies.build(t, "pca_reduced_full", ["m0"], components=4).columns) == 4
    with pytest.raises(ValueError):
        strategies.build(t, "other")
    with pytest.raises(ValueError):
        strategies.scaled(strategies.build(t, "mean_va"), "x")
    names = spark.createDataFrame([("Moods::calm",), ("Genres::rock",)], "feature string")
    assert strategies.metadata_policy("report_only", names, 1.0)["effective_weight"] == 0 and strategies.metadata_policy("", names, 0.5)["used_for_clustering"]
    for policy in ("non_affective_metadata", "x"):
        with pytest.raises(ValueError):
            strategies.metadata_policy(policy, names, 1.0)
    off = strategies.without_blocks([F.lit(True), F.lit(True), F.lit(True)], 0.0, 0.0)
    assert tuple(spark.range(1).select(*off).first()) == (True, False, False)


def test_losses(spark):
    df = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0], True), ([1.0, 0.0], [0.0, 1.0], False)], "a array<double>, b array<double>, m boolean")
    assert df.agg(training.masked_square_error(F.col("a"), F.col("b"), F.col("m"))).first()[0] == pytest.approx(0.25)
    assert [r[0] for r in df.select(training.cosine_distance(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 - math.sqrt(0.5)), 1.0]
    assert training.assignment_balance(df.filter("m"), "a", 2).first().loss == pytest.approx(0.0)
    t = training.target_distribution(df, "a", 2).collect()
    assert all(sum(r.target) == pytest.approx(1) for r in t)
    stop = training.EarlyStopping(2)
    assert [stop.step(v, v) for v in (1.0, 0.5, 0.6, 0.7)] == [False, False, False, True] and stop.state == 0.5


def test_datasets(spark):
    df = spark.createDataFrame([(i, float(i), i % 2 == 0, True) for i in range(10)], "idx long, x double, has_audio boolean, has_lyrics boolean")
    splits = spark.createDataFrame([("train", i) for i in range(6)] + [("val", i) for i in range(6, 10)], "split string, idx long")
    out = dataset.assemble(df, splits, "val", {"audio": (["x"], "has_audio")})
    assert [(r.idx, round(r.x_z, 4), r.x) for r in out.orderBy("idx").collect()] == [(6, round(4 / math.sqrt(8 / 3), 4), 6.0), (7, 0.0, 0.0), (8, round(6 / math.sqrt(8 / 3), 4), 8.0), (9, 0.0, 0.0)]
    kept, counts = dataset.both_views(df)
    assert kept.count() == 5 and tuple(counts.first()) == (5, 5) and dataset.split_rows(df, splits, "all").count() == 10
    assert [len(b) for b in dataset.batches(df, ["idx"], 4)] == [4, 4, 2] and sorted(i for b in dataset.batches(df, ["idx"], 4, seed=1) for i in b["idx"]) == list(range(10))
    assert dataset.group_weights("a=2, b=0.5", {"a": 1.0, "b": 1.0, "c": 1.0}) == {"a": 2.0, "b": 0.5, "c": 1.0} and dataset.view_names("Audio,lyrics,audio") == ["audio", "lyrics"] and dataset.yaml_quote('a"b\\') == '"a\\"b\\\\"'
    for bad in (lambda: dataset.split_rows(df, splits, "x"), lambda: dataset.group_weights("z=1", {}), lambda: dataset.group_weights("a=-1", {"a": 1.0}), lambda: dataset.view_names(""), lambda: dataset.checked(df, 3), lambda: dataset.plane_columns(df, ["idx"])):
        with pytest.raises(ValueError):
            bad()
    assert set(dataset.all_splits(df, splits, {"audio": (["x"], "has_audio")})) == {"train", "val", "test"} and dataset.seeded(1).random() == dataset.seeded(1).random()


def test_sampled_silhouette(spark):
    x, y = blobs(50)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "idx long, x double, y double, c int")
    full = neighbors.sampled_silhouette(df, ["x", "y"], "c", mode="full").first()
    assert full.silhouette == pytest.approx(E.mean_silhouette(x, y)) and full.negative == 0
    assert neighbors.sampled_silhouette(df, ["x", "y"], "c", limit=60, above=100).first().silhouette == pytest.approx(full.silhouette, abs=0.05)
    assert neighbors.sampled_silhouette(df.withColumn("c", F.lit(1)), ["x", "y"], "c").first().silhouette is None


def test_gates_of_a_run(spark):
    metrics = spark.createDataFrame([(4, True, 0.95, 0.01, True, 0.9)], "k int, min_size_ok boolean, seed_ari_mean double, seed_ari_std double, affect_gate_ok boolean, affect_weighted_dominant_ratio double")
    overlap = spark.createDataFrame([(False, 0.89, 1.02, 0.02)], "overlap_gate_ok boolean, va_knn_purity_20 double, va_center_radius_sep double, va_negative_silhouette_fraction double")
    probe = spark.createDataFrame([("residualized", 2), ("residualized", 1)], "tension_micro_source string, selected_micro_k int")
    runs_ = spark.createDataFrame([("main", "ok", 0.9), ("other", "ok", 0.5)], "config string, status string, claim_score double")
    tables = {f"overlap_{s}": overlap for s in audit.SPLITS} | {f"probe_{s}": probe for s in audit.SPLITS} | {"baseline": runs_, "ablation": runs_}
    summary = {"selected_k": 4, "selection_mode": "balanced_va_regions", "mask_purity_diagnostics": {"nmi": 0.01, "clusters": [{"enrichment_vs_baseline": 1.1}]}, "metadata_policy": {"metadata_policy": "report_only", "effective_metadata_cluster_weight": 0.0}, "require_both_va": True}
    gates = {r.gate: r.status for r in audit.audit_run(spark, summary, metrics, tables, {"tension": True, "alpha": True}, ["main", "other"], "main").collect()}
    assert len(gates) == 17 and set(gates.values()) == {"pass"}, gates
    bad = {r.gate: r.status for r in audit.audit_run(spark, summary | {"mask_purity_diagnostics": {"nmi": 0.2}, "metadata_policy": {}}, metrics.withColumn("affect_gate_ok", F.lit(False)), {}).collect()}
    assert bad["mask_nmi_below_0_05"] == bad["overlap_gate_train_val_test_all"] == bad["required_ablations_present"] == bad["metadata_policy_declared"] == "fail" and bad["affect_purity_gate"] == bad["max_mask_enrichment_below_1_30"] == "warn"
    row = reports.run_summary_row(spark, "main", summary, metrics.withColumn("balanced_region_score", F.lit(0.7))).first()
    assert (row.score, row.selected_k, row.metadata_policy, row.max_mask_enrichment, row.seed_ari_mean) == (0.7, 4, "report_only:weight=0", 1.1, 0.95)
    assert reports.run_summary_row(spark, "x", {}, None).first().status == "failed"
    assert reports.rerun_arguments("a", {"a": {"k": 3}}, {"seed": 1, "fast": True}) == ["--fast", "true", "--k", "3", "--seed", "1"]


def test_region_discovery_run(spark):
    config = search.Config(k_min=2, k_max=3, least=5, runs=2, starts=2)
    run = runs.discover_regions(tracks(spark, SF).filter("idx < 150"), config=config)
    assert run.rows.count() == 150 and run.facts["selected_k"] == run.summary.count() and min(r.size for r in run.summary.collect()) >= 5
    for k_strategy, strategy in (("composite", "balanced_va_diff"), ("latent_va_gmm", "latent_two_view_va")):
        few = tracks(spark, SF).filter("idx < 100 and (has_audio or has_lyrics)")
        assert runs.discover_regions(few, strategy, k_strategy, config).rows.select("cluster_id").distinct().count() <= 3
