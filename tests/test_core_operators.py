"""Operators on small closed-form fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope import schema
from duoscope.functions import text as X
from duoscope.functions.numeric import clip, clip01, finite, hash_split, quadrant, soft_weights, unit_rows
from duoscope.operators import audit, clustering, features, interpretation, joins, neighbors, profiles, retrieval, selection, statistics
from duoscope.sources import tables


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_column_resolution(spark):
    assert schema.find_column(["Track ID", "x"], ["track_id"]) == "Track ID"
    assert schema.find_column(["A-b", "a_b"], ["a_b"]) == "a_b"  # the last of equal forms
    assert schema.find_column(["Balanced (V)"], ["balanced v"], schema.script_form) == "Balanced (V)"
    with pytest.raises(ValueError):
        schema.find_column(["x"], ["y"], required=True)
    assert schema.canonical(spark.createDataFrame([(1, 2)], "Identifier int, Delta_V int"), ["song_id", "tension_dv"]).columns == ["song_id", "tension_dv"]


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), (None,), ("-3",)], "s string")
    assert one(df, finite("s"), clip01("s"), clip(finite("s"), 0, 1)) == [(1.5, 1.0, 1.0), (None, 0.0, None), (None, 0.0, None), (None, 0.0, None), (None, 0.0, None), (-3.0, 0.0, 0.0)]
    df = spark.createDataFrame([(0.9, 0.9), (0.1, 0.9), (0.1, 0.1), (0.9, 0.1), (0.52, 0.9), (None, 0.1)], "v double, a double")
    assert one(df, quadrant("v", "a"), quadrant("v", "a", margin=0.05)) == [(0, 0), (1, 1), (2, 2), (3, 3), (0, -1), (-1, -1)]
    shares = spark.range(4000).groupBy(hash_split("id", 1).alias("s")).count().collect()
    assert {r.s for r in shares} == {"train", "val", "test"}
    for r in shares:
        assert abs(r["count"] / 4000 - {"train": 0.70, "val": 0.15, "test": 0.15}[r.s]) < 0.03


def test_soft_weights_and_unit_rows(spark):
    df = spark.createDataFrame([(0.0, 2.0), (None, None), (0.0, 0.0), (1e6, 1e6)], "x double, y double")
    w = one(df, *soft_weights("x", "y"))
    assert w[0][0] == pytest.approx(1 / (1 + math.exp(-2))) and w[1] == w[2] == w[3] == (0.5, 0.5)
    assert one(df, *unit_rows("x", "y")) == [(0.0, 1.0), (None, None), (0.0, 0.0), (pytest.approx(math.sqrt(0.5)), pytest.approx(math.sqrt(0.5)))]


def test_text_functions(spark):
    df = spark.createDataFrame([("C2 rock",), ("C12",), ("2.0",), ("none",), (None,)], "s string")
    assert [r[0] for r in one(df, X.cluster_number("s"))] == [2, 2, 2, None, None]
    df = spark.createDataFrame([("Q1",), ("1",), ("1.0",), ("4",), ("4.0",), ("",), (None,)], "s string")
    assert [r[0] for r in one(df, X.label_number("s"))] == [0, 0, 1, 3, -1, -1, -1]
    df = spark.createDataFrame([("Rock, , pop|Jazz-Fusion",)], "s string")
    assert one(df, X.token_list("s", ",;|"), X.slug("s")) == [(["rock", "pop", "jazz fusion"], "rock-pop-jazz-fusion")]
    tokens = F.array(F.lit("a"), F.lit("B"), F.lit("b"), F.lit("c"))
    assert one(df, X.weight_list(F.lit("2,x"), tokens), X.distinct_display(tokens, 2)) == [([2.0, 1.0, 1.0, 1.0], ["a", "B"])]
    assert one(df, *X.macro_micro(F.lit("M2-b")), *X.feature_parts(F.lit("Moods::calm"))) == [(2, 1, "b", "Moods", "calm")]
    assert one(df, X.keyword_grade(F.lit("Warm war"), ["war", "warm", "sad"]), X.agreement_grade(F.lit("strong")), X.agreement_grade(F.lit("9"))) == [(2, 3, 3)]


def test_geometry_of_one_row(spark):
    df = spark.createDataFrame([(0.8, 0.6, 0.2, 0.7, True, True), (0.7, 0.3, 0.0, 0.0, True, False), (0.0, 0.0, 0.0, 0.0, False, False)], "av double, aa double, lv double, la double, has_audio boolean, has_lyrics boolean")
    g = features.geometry(df).collect()
    gap = math.hypot(0.6, 0.1) / math.sqrt(2)
    want = {"con_v": 0.5, "con_a": 0.65, "d_v": 0.6, "d_a": -0.1, "abs_v": 0.6, "abs_a": 0.1, "gap": gap, "mean_abs": 0.35, "agreement": math.exp(-0.5 * (gap / 0.35) ** 2), "m_both": 1}
    assert all(g[0][k] == pytest.approx(v) for k, v in want.items())
    assert (g[1].con_v, g[1].gap, g[2].con_v, g[2].cosine) == (0.7, 0.0, 0.5, 0.0)


def test_scaling_uses_observed_rows(spark):
    df = spark.createDataFrame([(1.0, True), (3.0, True), (100.0, False)], "x double, seen boolean")
    assert one(features.scaled(df, ["x"], "seen"), "x_z") == [(-1.0,), (1.0,), (0.0,)]


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, 1), (1, 2)], "k int, w int")
    with pytest.raises(Exception, match="repeats a key"):
        joins.one_to_one(left, twice, ["k"]).collect()
    with pytest.raises(Exception, match="no partner"):
        joins.one_to_one(left, twice.limit(1), ["k"], strict=True).collect()
    merged = joins.merge_fill(spark.createDataFrame([(1, None), (2, 5.0)], "k int, x double"), spark.createDataFrame([(1, 4.0), (2, 6.0), (3, 7.0)], "k int, x double"), "k")
    assert sorted(map(tuple, merged.collect())) == [(1, 4.0, False), (2, 5.0, True), (3, 7.0, False)]
    assert sorted(one(joins.pair_index(spark.range(50).withColumn("k", -F.col("id")), "k"), "k", "pair_index")) == [(-49 + i, i) for i in range(50)]


def points(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2))
    return x, spark.createDataFrame([(i, float(a), float(b), i % 3) for i, (a, b) in enumerate(x)], "idx long, x double, y double, c int")


def test_neighbours_and_silhouette(spark):
    x, df = points(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = {(r.idx, r.place): r.neighbour for r in neighbors.nearest(df, df, ["x", "y"], 5).collect()}
    for i in range(60):
        order = [j for j in np.argsort(d[i], kind="stable") if j != i][:5]
        assert [got[i, p + 1] for p in range(5)] == order
    c = np.arange(60) % 3
    for r in neighbors.silhouette(df, ["x", "y"], "c").collect():
        a = d[r.idx][(c == c[r.idx])].sum() / 19
        b = min(d[r.idx][c == k].mean() for k in range(3) if k != c[r.idx])
        assert r.silhouette == pytest.approx((b - a) / max(a, b))


def test_contingency_metrics(spark):
    df = spark.createDataFrame([(0, 0)] * 4 + [(1, 0)] * 2 + [(1, 1)] * 2, "k int, q int")
    p = statistics.affect_purity(df, "k", "q").first()
    assert (p.min_dominant, p.weighted_dominant, p.mixed_fraction, p.worst_cluster, p.valid_fraction) == (0.5, 0.75, 0.5, 1, 1.0)
    same = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int")
    assert statistics.adjusted_rand(same, "a", "b").first().ari == pytest.approx(1) and statistics.mutual_information(same, "a", "b").first().nmi == pytest.approx(1)


def test_enrichment_is_hypergeometric(spark):
    rows = [(i, i // 10, "t") for i in range(8)] + [(i, i // 10, "t") for i in (12, 15, 18)] + [(i, i // 10, "u") for i in range(20)]
    got = {(r.g, r.token): r for r in statistics.enrichment(spark.createDataFrame(rows, "k int, g int, token string"), "k", "g", "token").collect()}
    want = sum(math.comb(11, x) * math.comb(9, 10 - x) for x in range(8, 11)) / math.comb(20, 10)
    assert got[0, "t"].p == pytest.approx(want) and got[0, "u"].p == pytest.approx(1) and (1, "t") not in got and got[0, "t"].q >= got[0, "t"].p


def test_percentiles_sum_and_roles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 4, float(a), float(b), float(c), float(d), f"T{i % 2}", "bright lift" if i % 2 else "modality-consistent", "t", "a") for i, (a, b, c, d) in enumerate(rng.random((80, 4)) - 0.2)]
    df = spark.createDataFrame(rows, "idx long, cluster_id int, bv double, ba double, dv double, da double, tension_label string, tension_name string, title string, artist string").withColumn("norm", F.sqrt(F.col("dv") ** 2 + F.col("da") ** 2))
    out = tables.stored(profiles.review_flags(profiles.tension_profiles(profiles.region_profiles(df))), "t").collect()
    assert len(out) == 80
    for r in out:
        assert sum(r[f"w_{i}"] for i in range(4)) == pytest.approx(1) and 0 <= r.region_typicality <= 1 and 0 < r.tension_percentile <= 1
        assert (r.selected_role == "boundary_case") == (r.boundary_flag or r.descriptor_conflict)


def test_interpretation_ladders(spark):
    base = {"cluster_id": 0, "w_0": 0.9, "w_1": 0.05, "w_2": 0.03, "w_3": 0.02, "nearest_alt": 1, "region_margin": 1.0, "region_typicality": 0.9, "region_confidence": 0.9, "tension_percentile": 0.1, "tension_name": "x", "dv": 0.0, "da": 0.0}
    rows = [base, base | {"cluster_id": 3, "w_3": 0.5, "nearest_alt": 1, "w_1": 0.45, "region_margin": -0.1}, base | {"cluster_id": 2, "w_2": 0.9, "w_0": 0.05, "tension_percentile": 0.65, "dv": 0.2, "da": -0.1, "nearest_alt": 0}]
    got = interpretation.interpret(spark.createDataFrame(rows)).collect()
    assert {"Concordant Subdued Melancholy", "Playful Vitality / Gentle Warmth Boundary Blend"} <= {r.final_label for r in got}
    assert {r.tension_overlay for r in got} >= {"Valence-Reframed Intensity"} and "lyric_valence_uplift; lyric_arousal_softening" in {r.cross_modal_relation for r in got}


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([("q", s, f"t{i}", i) for s in ("va_only", "full") for i in range(1, 6)], "query_id string, system string, track_id string, rank int")
    ranked = ranked.withColumn("track_id", F.when(F.col("system") == "full", F.concat(F.lit("t"), 6 - F.col("rank"))).otherwise(F.col("track_id")))
    labels = spark.createDataFrame([("q", "t5", 3.0), ("q", "t4", 2.0)], "query_id string, track_id string, grade double")
    m = {(r.system, r.k): r for r in retrieval.evaluate(ranked, labels, [1, 5]).collect()}
    assert m["full", 5].ndcg == pytest.approx(1) and m["va_only", 1].ndcg == 0 and m["full", 5].precision == 0.4 and m["va_only", 5].judged == 2
    wins = {r.system: r.win_rate for r in retrieval.compare_systems(retrieval.evaluate(ranked, labels, [1]), k=1).collect()}
    assert wins == {"full": 1.0, "va_only": None}


def test_names(spark):
    pairs = [(0.96, 0.90, "Euphoric Excitement"), (0.53, 0.37, "Bittersweet Nostalgia"), (0.84, 0.59, "Bright Romantic Vitality"), (0.11, 0.36, "Lonely Melancholy"), (0.74, 0.08, "Restorative Calm")]
    df = spark.createDataFrame(pairs, "v double, a double, name string")
    assert all(x == y for x, y in one(df, selection.region_name(F.col("v"), F.col("a"), F.lit(1)), "name"))
    assert one(df.limit(1), selection.subtype_name(F.lit(0.21), F.lit(0.19), F.lit(0.29))) == [("High Cross-Modal Tension: Lyric Valence Uplift + Lyric Arousal Intensification",)]


def test_balanced_regions_keep_their_sizes(spark):
    rng = np.random.default_rng(2)
    blobs = np.concatenate([rng.normal(c, 0.045, (n, 2)) for c, n in (((0.24, 0.25), 70), ((0.26, 0.76), 70), ((0.76, 0.25), 70), ((0.78, 0.76), 20))])
    df = tables.stored(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(blobs)], "idx long, x double, y double"), "blobs")
    sizes = [r["count"] for r in clustering.balanced_regions(df, ["x", "y"], 4, 50, starts=1, most=3).labelled.groupBy("region").count().collect()]
    assert len(sizes) == 4 and min(sizes) >= 50 and sum(sizes) == 230


def test_masked_mixture_and_assignment(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal(5 * (i % 2), 0.3)), float(rng.normal(5 * (i % 2), 0.3)), i % 5 != 0) for i in range(200)]
    df = tables.stored(spark.createDataFrame(rows, "idx long, x double, y double, seen boolean"), "mix")
    m = clustering.gaussian_mixture(df, ["x", "y"], 2, {"y": "seen"}, most=10)
    assert all(b >= a - 1e-9 for a, b in zip(m.bounds, m.bounds[1:]))
    pairs = {(r[0] % 2, r[1]) for r in one(df, "idx", m.predict())}
    assert len(pairs) == 2
    cost = rng.random((4, 6))
    best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(6), 4))
    assert sum(cost[i, j] for i, j in enumerate(clustering.hungarian(cost))) == pytest.approx(best)


def test_gates_and_alignment(spark):
    m = spark.createDataFrame([(0.89, 1.02, 0.02, 0.95, True, 0.5)], "purity_20 double, separation double, negative_fraction double, seed_ari double, min_size_ok boolean, affect_purity double")
    gates = {r.gate: r.status for r in audit.overlap_gates(m).collect()}
    assert gates == {"overlap": "pass", "seed_stability": "pass", "min_size": "pass", "affect_purity": "warn"} and audit.ready(audit.overlap_gates(m)).first().ready
    s = spark.createDataFrame([(0, 0.7, 0.3), (1, 0.2, 0.8)], "cluster_id int, bv double, ba double")
    big = spark.createDataFrame([(0, 0.21, 0.79), (1, 0.72, 0.31), (2, 0.75, 0.35)], "cluster_id int, bv double, ba double")
    assert [(a, b, e) for a, b, _, e in audit.align_regions(s, big)] == [(0, 1, False), (0, 2, True), (1, 0, False)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Track ID,v\nx,1.5\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("x", "1.5")]
    (tmp_path / "s.json").write_text('{"train": {"indices": [1, 2]}, "validate": [3]}')
    assert sorted(map(tuple, tables.read_split(spark, str(tmp_path / "s.json")).collect())) == [("train", 1), ("train", 2), ("val", 3)]
    with pytest.raises(Exception, match="repeats"):
        tables.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_streaming(spark, tmp_path):
    from duoscope.streaming import events

    df = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, 'a' AS event_type, 1.0D AS value FROM range(120)")
    df.write.parquet(str(tmp_path / "e"))
    q = events.windowed(events.read_events(spark, str(tmp_path / "e"), df.schema)).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("w").collect()) == [60, 60]
