"""Findings on work that was done on a sample: models, counts and metrics are of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.operators import micro, search, whole
from duoscope.operators import estimators as E


def blobs(sizes, wide=0.07, seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, wide, (n, 2)) for c, n in zip(((0.24, 0.25), (0.26, 0.76), (0.76, 0.25), (0.78, 0.76)), sizes)])


def test_balanced_search_is_of_all_rows(spark):
    """Beyond the rows that are held in memory, every metric is that of the whole table by brute force."""
    x = blobs([300, 260, 200, 40])
    config = search.Config(k_min=2, k_max=4, least=120, runs=2, starts=10, sample=100)
    data = search.Data(x, np.ones((len(x), 1), bool), [(0, 2)])
    found = search.search(spark, data, "balanced_va_regions", config)
    table = whole.Table.of(spark, data)
    hashes = np.array([r["_h"] for r in table.rows.orderBy(F.col("_k").cast("int")).select("_h").collect()])
    labels = found.model.predict(x, hashes)
    assert np.bincount(labels, minlength=found.k).min() >= 120
    want, got = E.plane_metrics(x, labels), found.metrics.filter(F.col("k") == found.k).first()
    names = {"silhouette": "va_mean_silhouette", "plane_silhouette": "va_mean_silhouette", "purity_10": "va_knn_purity_10", "purity_20": "va_knn_purity_20", "separation": "va_center_radius_sep", "negative": "va_negative_silhouette_fraction"}
    assert {n: got[n] for n in names} == {n: pytest.approx(want[w], abs=1e-9) for n, w in names.items()}
    held = search.search(spark, data, "balanced_va_regions", search.Config(k_min=2, k_max=4, least=120, runs=2, starts=10))
    assert {r.k: r.inertia for r in found.metrics.collect()} == {r.k: pytest.approx(r.inertia, rel=0.02) for r in held.metrics.collect()}


def test_other_plane_than_the_features_and_a_single_region(spark):
    x = np.random.default_rng(1).normal(size=(150, 3))
    data = search.Data(x, np.ones((len(x), 1), bool), [(0, 3)], plane=x[:, :2] * [1.0, 3.0])
    found = search.search(spark, data, "balanced_va_regions", search.Config(k_min=1, k_max=2, least=5, runs=1, starts=2, sample=50, diagnostic=True)).metrics
    one, two = found.orderBy("k").collect()
    assert (one.silhouette, one.plane_silhouette, one.overlap_ok) == (0.0, None, False)
    assert two.silhouette > 0 and two.silhouette != two.plane_silhouette and two.separation > 0


def test_starts_are_drawn_from_all_rows(spark):
    """By their squared distances: of two places one of which has a single row, a second centre is always the other one."""
    x = np.concatenate([np.zeros((500, 2)), [[5.0, 5.0]]])
    table = whole.Table.of(spark, whole.Data(x))
    [centres] = whole.spread_centres(table, [whole.Fits(3, list(range(40)), 2)])
    assert centres.shape == (40, 3, 2) and all(len(np.unique(c[:2], axis=0)) == 2 for c in centres)
    firsts = whole.spread_centres(whole.Table.of(spark, whole.Data(blobs([100, 100, 100, 100]))), [whole.Fits(1, list(range(60)), 2)])[0]
    assert len(np.unique(firsts[:, 0], axis=0)) > 50


def tension(spark, sizes, seed=5):
    """Clusters of three directions each; of the second one, differences are all the same."""
    rng = np.random.default_rng(seed)
    rows = []
    for c, n in enumerate(sizes):
        d = np.array([[0.3, 0.0], [-0.25, 0.12], [0.0, -0.3]])[np.arange(n) % 3] + rng.normal(0, 0.04, (n, 2)) if c != 1 else np.full((n, 2), 0.1)
        rows += [(c, float(a), float(b), float(np.hypot(a, b))) for a, b in d]
    df = spark.createDataFrame([(i, *r, i % 10 != 0) for i, r in enumerate(rows)], "idx long, cluster_id int, t_dv double, t_da double, t_norm double, pair_seen boolean")
    return df, {c: np.array([r[1:] for i, r in enumerate(rows) if r[0] == c and i % 10]) for c in range(len(sizes))}


def close(a, b):
    return a == b or a == pytest.approx(b, abs=1e-6, nan_ok=True) if isinstance(a, float) else a == b


def test_probe_is_of_all_rows(spark):
    """More rows than were drawn before."""
    df, rows = tension(spark, [11_500])
    summary, _, labelled = micro.probe(df)
    one = summary.first()
    assert one.observed == len(rows[0]) == 10_350
    sizes = {r.micro_id: r["count"] for r in labelled.groupBy("micro_id").count().collect()}
    assert one.selected_micro_k == 3 and one.min_size == min(n for i, n in sizes.items() if i >= 0) and sum(sizes.values()) == 11_500
    x = rows[0][:, :2] / rows[0][:, :2].std(0)
    ids = np.array([r.micro_id for r in labelled.filter("pair_seen").orderBy("idx").select("micro_id").collect()])
    assert one.silhouette == pytest.approx(E.mean_silhouette(x, ids), abs=1e-9) and one.effect == pytest.approx(E.variance_ratio(x, ids))


def test_probe_spread_over_tasks_is_the_one_in_memory(spark):
    df, rows = tension(spark, [600, 200, 330, 50, 20])
    held, spread = micro.probe(df), micro.probe(df, together=60)  # the last two clusters stay in their tasks
    for of_held, of_spread, key in zip(held[:2], spread[:2], (["cluster_id"], ["cluster_id", "k"])):
        a, b = of_held.orderBy(*key).collect(), of_spread.orderBy(*key).collect()
        assert len(a) == len(b) and all(r[c] == s[c] if c == "reason" else close(r[c], s[c]) for r, s in zip(a, b) for c in r.asDict()), (a, b)
    for table in (held, spread):
        assert [(r.observed, r.status) for r in table[0].orderBy("cluster_id").collect()] == [(540, "accepted"), (180, "no_signed_tension_variation"), (297, "accepted"), (45, "not_enough_observed_pairs"), (18, "not_enough_observed_pairs")]
    assert held[2].select("idx", "micro_id").exceptAll(spread[2].select("idx", "micro_id")).isEmpty()


def test_empty_regions_begin_anew(spark):
    """Three places for four centres: one region is empty, and goes to the row farthest from its centre."""
    x = np.repeat([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [30, 5, 1], 0)
    table = whole.Table.of(spark, whole.Data(x))
    [(centres, inertia)] = whole.kmeans(table, [whole.Fits(4, list(range(5)), 2)])
    assert np.isfinite(centres).all() and np.allclose(inertia, 0)
