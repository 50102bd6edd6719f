"""Neighbours by boxes, mixtures, size-bounded regions and agreement over whole tables, against versions in memory."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.operators import clustering, grid, runs, search, strategies, whole
from duoscope.operators import estimators as E
from duoscope.plans.adapters import tracks

SF = "/root/testdata/sf0.001"


def table(spark, x, keys=None, **more):
    keys = range(len(x)) if keys is None else keys
    columns = [f"x{i} double" for i in range(x.shape[1])]
    rows = [(k, *map(float, r), *(v[i] for v in more.values())) for i, (k, r) in enumerate(zip(keys, x))]
    return spark.createDataFrame(rows, ", ".join([f"idx {'string' if isinstance(rows[0][0], str) else 'long'}", *columns, *(f"{n} double" for n in more)]))


def nearest_of(left, right, keys, k, own=True):
    d = sum((left[:, None, a] - right[None, :, a]) ** 2 for a in range(left.shape[1]))
    if own:
        np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.tile(np.argsort(np.argsort(keys)), (len(left), 1)), d))
    return [[keys[j] for j in row[: min(k, len(right) - own)]] for row in order]


def places(kind, n, rng, axes=2):
    if kind == "lattice":
        return rng.integers(0, 7, (n, axes)) / 4
    x = rng.normal(size=(n, axes))
    if kind == "crowded":  # a third at one place, a third close together, some far off
        x[: n // 3], x[n // 3 : 2 * n // 3] = 0.5, x[n // 3 : 2 * n // 3] * 1e-7 + 3
        x[-3:] *= 1e8
    return x


@pytest.mark.parametrize("kind, n, k, axes, box", [("normal", 900, 20, 2, 64), ("lattice", 700, 12, 2, 64), ("crowded", 900, 101, 2, 64), ("normal", 300, 5, 4, 32), ("normal", 12, 30, 2, 2048)])
def test_nearest_rows(spark, monkeypatch, kind, n, k, axes, box):
    monkeypatch.setattr(grid, "BOX", box)  # many boxes and all rounds of rings
    monkeypatch.setattr(grid, "RINGS", [1, 3, 9, 1 << 15])
    x = places(kind, n, np.random.default_rng(n), axes)
    df = table(spark, x, w=[float(i) * 3 for i in range(n)])
    found = grid.nearest(df, df, [f"x{i}" for i in range(axes)], k, carry=["w"])
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.idx, []).append((r.place, r.neighbour, r.distance))
        assert r.w == r.neighbour * 3 and r.distance == pytest.approx(math.dist(x[r.idx], x[r.neighbour]), rel=1e-12)
    assert [[j for _, j, _ in sorted(got[i])] for i in range(n)] == nearest_of(x, x, list(range(n)), k)


def test_nearest_rows_of_another_table(spark, monkeypatch):
    monkeypatch.setattr(grid, "BOX", 50)
    rng = np.random.default_rng(1)
    far, there = rng.normal(40, 1, (150, 2)), rng.normal(0, 1, (400, 2))  # every place lies outside of all boxes
    keys = [f"k{i:03d}é" for i in range(400)]
    got = grid.nearest(table(spark, far, [f"l{i}" for i in range(150)]), table(spark, there, keys), ["x0", "x1"], 7, exclude_self=False)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.idx, []).append((r.place, r.neighbour))
    assert [[j for _, j in sorted(rows[f"l{i}"])] for i in range(150)] == nearest_of(far, there, keys, 7, own=False)


def test_nearest_leaves_out_what_has_no_place(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, 1.0, -0.0), (6, 1.0, 0.0)], "idx long, x0 double, x1 double")
    got = {(r.idx, r.place): r.neighbour for r in grid.nearest(df, df, ["x0", "x1"], 3).collect()}
    assert got == {(1, 1): 5, (1, 2): 6, (5, 1): 6, (5, 2): 1, (6, 1): 5, (6, 2): 1}
    none = grid.nearest(df, df.limit(0), ["x0", "x1"], 3, carry=["x0"])
    assert none.collect() == [] and none.columns == ["idx", "neighbour", "distance", "x0", "place"]
    assert grid.nearest(df.limit(0), df, ["x0", "x1"], 3).collect() == []


def blobs(n=60, wide=0.04, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, wide, (n, 2)) for c in ((0.24, 0.25), (0.26, 0.76), (0.76, 0.25), (0.78, 0.76))])
    return x, np.repeat(np.arange(4), n)


def two_views(n=60):
    x, y = blobs(n)
    rng = np.random.default_rng(1)
    views = np.stack([x + [0.05, -0.02] + rng.normal(0, 0.02, x.shape), x - [0.05, -0.02] + rng.normal(0, 0.05, x.shape)])
    seen = np.ones((2, len(x)), bool)
    seen[0, ::5] = False
    seen[1, 2::7] = False
    seen[0, ~seen.any(0)] = True
    return whole.Data(x, None, None, np.where(seen[:, :, None], views, np.nan), seen), y


def test_likelihood_of_two_views_never_falls():
    data, y = two_views()
    views = np.where(data.view_seen[:, :, None], data.views, 0.0)
    for share, prior in ((False, 0.0), (True, 0.0)):
        model, bounds = E.latent_start(views, data.view_seen, 4, 3, True, share, prior, 1e-6), []
        for _ in range(40):
            model = model.updated(model.sums(views, data.view_seen))
            bounds.append(model.bound)
        assert min(np.diff(bounds)) > -1e-9
    one = [j for j in range(len(y)) if data.view_seen[:, j].all()][0]
    for k in range(4):  # against the density of a plain two-dimensional normal
        density = math.log(model.weights[k])
        for a in range(2):
            cov = model.spread[k, a] + np.diag(model.noise[:, k, a])
            off = views[:, one, a] - model.means[k, a] - model.bias[:, k, a]
            density -= 0.5 * (math.log(np.linalg.det(2 * math.pi * cov)) + off @ np.linalg.solve(cov, off))
        assert model.log_joint(views, data.view_seen)[one, k] == pytest.approx(density)


def test_latent_mixture_of_a_whole_table(spark):
    data, y = two_views()
    rows = whole.Table.of(spark, data)
    begun = E.latent_mixture(*(a[:, ::6] for a in (np.nan_to_num(data.views), data.view_seen)), 4)  # begun on a sixth of the rows
    [model] = whole.polished(rows, [begun], tolerance=1e-6)
    assert model.converged and model.bound > whole.certainty(rows, [begun])[0][0] / len(y)
    assert E.rand_index(model.predict(np.nan_to_num(data.views), data.view_seen), y) > 0.97
    assert model.bias[0].mean(0) == pytest.approx([0.05, -0.02], abs=0.012) and np.allclose(model.bias.sum(0), 0)
    assert np.allclose(sorted(model.means.sum(1)), sorted([0.49, 1.02, 1.01, 1.54]), atol=0.03)
    likelihood, certain, margin = whole.certainty(rows, [model])[0]
    views = np.nan_to_num(data.views)
    p = model.probability(views, data.view_seen)
    assert likelihood == pytest.approx(E.log_sum_exp(model.log_joint(views, data.view_seen)).sum()) and search.criteria(model, (likelihood, certain, margin), len(y))["icl"] == pytest.approx(model.icl(views, data.view_seen))
    top = np.sort(p, 1)
    assert margin == pytest.approx((top[:, -1] - top[:, -2]).mean())


def test_steps_over_a_table_are_those_in_memory(spark):
    x, _ = blobs(40)
    seen = np.ones((len(x), 2), bool)
    seen[::4, 1] = False
    data = whole.Data(x, seen, [(0, 1), (1, 2)])
    model = E.mixture(x, 3, seen, seed=2, most=2)
    [got] = whole.polished(whole.Table.of(spark, data), [model], steps=4, tolerance=-1.0)
    want = model
    for _ in range(4):
        want = want.updated(want.sums(x, seen))
    assert np.allclose(got.means, want.means) and np.allclose(got.variances, want.variances) and np.allclose(got.weights, want.weights)
    [weighted] = whole.polished(whole.Table.of(spark, data), [model], [3], steps=1, tolerance=-1.0)
    sample = whole.Table.of(spark, data).sample(1000, 1)
    w = whole.replicate_weights(sample.hashes, 3)
    assert np.allclose(weighted.means, model.updated(model.sums(sample.x, sample.seen, w)).means)


def test_replicate_weights():
    h = np.arange(200_000) * 7919
    w = whole.replicate_weights(h, 1)
    assert w.mean() == pytest.approx(0.8, abs=0.01) and w.var() == pytest.approx(0.8, abs=0.02) and (w != whole.replicate_weights(h, 2)).mean() > 0.5


def test_agreement_is_that_of_all_rows(spark):
    x, y = blobs(30)
    models = [E.kmeans(x, k, s, 1) for k, s in ((4, 0), (3, 1), (5, 2))]
    data = whole.Data(x, patterns=y % 2, quadrants=y)
    told = whole.labelled(whole.Table.of(spark, data), models)
    labels = [m.predict(x) for m in models]
    tables = whole.agreement(told, [(0, 1), (0, 2), (1, 2)], [4, 3, 5])
    assert [E.rand_of_table(t) for t in tables] == pytest.approx([E.rand_index(labels[i], labels[j]) for i, j in ((0, 1), (0, 2), (1, 2))])
    assert whole.agreement(told, [], []) == []
    for i, counts in whole.cells(told).items():
        assert search.sizes_of(counts, 5)[: labels[i].max() + 1].tolist() == np.bincount(labels[i]).tolist()
        assert search.mask_leak(counts)["mask_nmi"] == pytest.approx(E.information_of_table(E.contingency(labels[i], y % 2)))


def cheapest(d, least):
    """The least cost of an assignment of a minimum size, by shortest paths of moves."""
    n, k = d.shape
    label = d.argmin(1)
    while (sizes := np.bincount(label, minlength=k)).min() < least:
        step, row = np.full((k, k), np.inf), np.zeros((k, k), int)
        for a in range(k):
            own = np.flatnonzero(label == a)
            for b in range(k):
                if a != b and len(own):
                    m = d[own, b] - d[own, a]
                    step[a, b], row[a, b] = m.min(), own[m.argmin()]
        far, before = np.where(sizes > least, 0, np.inf), np.full(k, -1)
        for _ in range(k):
            for a in range(k):
                for b in range(k):
                    if far[a] + step[a, b] < far[b] - 1e-12:
                        far[b], before[b] = far[a] + step[a, b], a
        at = min((j for j in range(k) if sizes[j] < least), key=lambda j: far[j])
        while before[at] >= 0:
            label[row[before[at], at]] = at
            at = before[at]
    return d[np.arange(n), label].sum()


@pytest.mark.parametrize("seed", range(12))
def test_prices_hold_sizes_at_little_cost(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(30, 200)), int(rng.integers(2, 7))
    x, centres, least = rng.normal(size=(n, 2)), rng.normal(size=(k, 2)) * 2, int(n / k * rng.uniform(0.3, 1.0))
    x = np.round(x * 2) / 2 if seed % 3 == 0 else x  # many rows of one place
    model, hashes = E.Partition(centres, None, 0.0, None, 1e-9), np.arange(n) * 2654435761
    E.settle(model, least, x, hashes)
    label, d = model.predict(x, hashes), ((x[:, None] - centres[None]) ** 2).sum(2)
    assert np.bincount(label, minlength=k).min() >= least and d[np.arange(n), label].sum() <= 1.05 * cheapest(d, least)


def test_regions_of_a_whole_table_keep_their_sizes(spark):
    """A third of the rows at one place, a region that is far too small, and labels by expressions as by the model."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.045, (n, 2)) for c, n in (((0.24, 0.25), 700), ((0.26, 0.76), 500), ((0.76, 0.25), 400), ((0.78, 0.76), 60))])
    x = np.concatenate([x, np.full((800, 2), 0.4)])
    df = table(spark, x)
    found = clustering.balanced_regions(df, ["x0", "x1"], 4, 500, starts=2, sample=400)
    sizes = {r.region: r["count"] for r in found.labelled.groupBy("region").count().collect()}
    assert len(sizes) == 4 and min(sizes.values()) >= 500
    label = np.zeros(len(x), int)
    for r in found.labelled.collect():
        label[r.idx] = r.region
    centres = np.array(found.centres)
    assert np.allclose(centres, np.stack([x[label == i].mean(0) for i in range(4)]), atol=1e-3)
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert d[np.arange(len(x)), label].sum() <= 1.05 * cheapest(d, 500)
    with pytest.raises(ValueError):
        clustering.balanced_regions(df, ["x0", "x1"], 4, 1000)


def test_labels_by_expressions(spark):
    """Every kind of model labels a table by column expressions as it does in memory."""
    t = tracks(spark, SF).filter("has_audio or has_lyrics")
    for strategy, kinds in (("calibrated_va_tension", ("two", "balanced", "nested", "mixture")), ("latent_two_view_va", ("latent",))):
        features = strategies.build(t, strategy)
        rows = runs.table_of(features)
        data = rows.sample(10_000, 0)
        order = [r._k for r in rows.rows.orderBy(F.xxhash64(F.lit(0), "_k"), "_k").collect()]
        for kind in kinds:
            model = {
                "two": lambda: E.TwoLevel(2, features.blocks, 5, 2, 3, starts=2).fit(data.x, data.seen), "nested": lambda: E.nested(data.x, range(2, 4), range(2, 3), 5, starts=2),
                "mixture": lambda: E.mixture(data.x, 3, data.columns_seen()), "latent": lambda: E.latent_mixture(data.views, data.view_seen, 3, starts=2),
                "balanced": lambda: E.balanced(data.x, 4, len(data.x) // 5, 1, 2, 20, data.hashes),
            }[kind]()
            got = {str(r.idx): r.cluster_id for r in runs.labels_of(features, search.Found(0, model, None)).collect()}
            assert [got[k] for k in order] == whole.predicted(model, data).tolist(), kind


@pytest.mark.parametrize("k_strategy", search.STRATEGIES)
def test_discovery_by_every_search(spark, k_strategy):
    config = search.Config(k_min=2, k_max=3 if "micro" not in k_strategy else 20, least=4, least_ratio=0.0, runs=2, starts=2, macro_min=2, macro_max=2, micro_min=1, micro_max=2)
    strategy = "latent_two_view_va" if k_strategy == "latent_va_gmm" else "calibrated_va_tension"
    t = tracks(spark, SF).filter("has_audio or has_lyrics")
    run = runs.discover_regions(t, strategy, k_strategy, config)
    labels = [r.cluster_id for r in run.rows.select("cluster_id").collect()]
    assert len(labels) == t.count() and len(set(labels)) == run.found.k and run.facts["k_strategy"] == k_strategy
    if k_strategy == "balanced_va_regions":
        assert np.bincount(labels).min() >= 4
