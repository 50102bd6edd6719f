"""Faults that larger tables showed: values that come out otherwise when computed again, bounds that are drawn anew, single tasks."""

import random

import duckdb
import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F

from duoscope.functions.numeric import decimals, r6
from duoscope.operators import distances, grid, joins, micro, neighbors, profiles, search, statistics, whole
from duoscope.operators import estimators as E
from duoscope.plans import adapters


def test_ranks_keep_rows_whose_values_change_when_computed_again(spark):
    """Sums of doubles depend on the order in which partial sums arrive; here every computation differs."""
    drawn = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    df = spark.range(500).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("g")).withColumn("x", drawn())
    ranked = statistics.with_ranks(df, F.col("x"), "g", ecdf="e", centrality="c").collect()
    assert sorted(r["idx"] for r in ranked) == list(range(500))
    rows = statistics.with_many_ranks(df, "idx", {"e": (F.col("x"), ["g"], "ecdf"), "c": (F.col("x"), ["g"], "centrality")}).collect()
    assert sorted(r["idx"] for r in rows) == list(range(500))
    for found in (ranked, rows):
        for g in range(3):
            mine = sorted((r["x"], r["e"], r["c"]) for r in found if r["g"] == g)
            for i, (_, e, c) in enumerate(mine):
                assert abs(e - (i + 1) / len(mine)) < 1e-12 and abs(c - (1 - i / len(mine))) < 1e-12


def test_pair_index_counts_on_over_ranges(spark):
    """Small shuffle partitions are put together by their bytes, which differ between numbers and sizes."""
    changed = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 40_000, 1, 6).select((F.col("id") * 7919 % 40_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
        rows = joins.pair_index(df, "k").select("k", "v", "pair_index").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 40_000 and all(r["k"] == r["pair_index"] for r in rows)


def test_ranks_round_as_duckdb_rounds(spark):
    shares = [(float(1 - k / n),) for n in (640, 1280, 12_800, 64_000) for k in range(0, n, max(1, n // 500))]
    told = spark.createDataFrame(shares, "x double").select("x", r6("x").alias("r"), decimals(-F.col("x"), 4).alias("s")).collect()
    db = duckdb.connect()
    for r in told:
        assert (r["r"], r["s"]) == db.execute("SELECT round(?::DOUBLE, 6), round(?::DOUBLE, 4)", [r["x"], -r["x"]]).fetchall()[0]


def test_descriptors_of_one_raw_weight_are_in_the_order_of_their_share(spark):
    """Two names whose weights are equal to six decimals, and whose shares of the highest are not."""
    row = {"idx": 1, "cluster_id": 2, "nearest_alt": 1, "boundary_flag": False, "region_confidence": 0.5, "nearest_alt_weight": 0.2, "region_typicality": 0.02, "w_0": 0.2000012, "w_1": 0.2, "w_2": 0.5, "w_3": 0.2000008,
           "w_tension": 0.0, "tension_percentile": 0.1, "tension_typicality": 0.0, "tension_label": "T1", "tension_name": "x", "dv": 0.0, "da": 0.0, "dv_percentile": 0.0, "da_percentile": 0.0, "abs_dv_percentile": 0.0, "abs_da_percentile": 0.0}
    found = profiles.descriptors(spark.createDataFrame([row]), most=50).orderBy("place").collect()
    assert [(r["weight"], r["raw"], r["descriptor"]) for r in found] == sorted(((r["weight"], r["raw"], r["descriptor"]) for r in found), key=lambda t: (-t[0], -t[1], t[2]))


def test_silhouettes_by_boxes_are_those_by_pairs(spark, monkeypatch):
    """Repeated places, a row alone in its label and one far off; 64 boxes, of which most act through nodes."""
    monkeypatch.setattr(distances, "ALONE", 64)
    draw = random.Random(5)
    at = [(draw.gauss(0.5, 0.07), draw.gauss(0.5, 0.07)) for _ in range(2400)]
    at += at[:300] + [(0.5, 0.5)] * 300 + [(9.0, -3.0)]
    df = spark.createDataFrame([(i, x, y, 7 if i == 5 else i % 3) for i, (x, y) in enumerate(at)], "idx long, x double, y double, g int")
    by_boxes = {r["idx"]: r["silhouette"] for r in neighbors.silhouette(df, ["x", "y"], "g").collect()}
    by_pairs = {r["idx"]: r["silhouette"] for r in neighbors._silhouette_by_pairs(df, ["x", "y"], "g", "idx").collect()}
    assert by_boxes.keys() == by_pairs.keys() and len(by_boxes) == len(at) and by_boxes[5] == 0
    assert max(abs(by_boxes[i] - by_pairs[i]) for i in by_boxes) < 1e-11
    found = grid.nearest(df, df, ["x", "y"], 5).select("idx", "neighbour", "place")
    one, many = neighbors.purity_among(found, df, "g", 5).first()["purity"], neighbors.label_purities(df, ["x", "y"], "g", [5, 8]).first()
    assert one == many["purity_5"] and many["purity_8"] == neighbors.label_purity(df, ["x", "y"], "g", 8).first()["purity"]


def test_sides_that_grow_are_merged(spark):
    """By the size of its file a table of some hundred thousand rows would be broadcast; only a row a range and group is."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(adapters.song(spark, "/root/testdata/sf0.001"))
    df = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("g"), F.sqrt("id").alias("x"))
    assert plan(statistics.with_ranks(df, F.col("x"), "g", ecdf="e")).count("SortMergeJoin") == 1
    assert plan(statistics.with_many_ranks(df, "idx", {"e": (F.col("x"), ["g"], "ecdf")})).count("SortMergeJoin") == 2


def test_rows_of_one_file_are_dealt_over_tasks(spark):
    one = spark.range(0, 200_000, 1, 1).select(F.col("id").cast("string").alias("_k"), F.array(F.rand(1), F.rand(2)).alias("_x"), F.xxhash64("id").alias("_h"))
    rows = whole.dealt(one)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1 and rows.select("_k").distinct().count() == 200_000


def test_a_round_without_prices_is_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (200, 2)) for c in ((0, 0), (2, 0), (0, 2))])
    table = whole.Table.of(spark, whole.Data(x, hashes=np.arange(len(x))))
    begun, passes, read, sums = E.Partition(x[[0, 200, 400]].copy(), np.zeros(0, int), 0.0), [], [], whole.over_rows

    def counted(table, work, most=False, columns=None):
        passes.append(len(work))
        read.append(columns)
        return sums(table, work, most, columns)

    monkeypatch.setattr(whole, "over_rows", counted)
    [model] = whole.priced(table, [begun], 50)
    centres = np.stack([x[i : i + 200].mean(0) for i in (0, 200, 400)])
    labels = E.squared(x, centres).argmin(1)
    assert np.allclose(model.centres, centres) and np.isclose(model.inertia, ((x - centres[labels]) ** 2).sum())
    assert len(passes) == 2 and all(c == ["_x", "_h"] for c in read)  # centres move once and rest


def test_prices_hold_sizes_with_sums_by_the_last_prices(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (n, 2)) for c, n in (((0, 0), 500), ((2, 0), 60), ((0, 2), 40))])
    table = whole.Table.of(spark, whole.Data(x))
    begun = E.Partition(x[[0, 500, 560]].copy(), np.zeros(0, int), 0.0, None, 1e-9)
    [model] = whole.priced(table, [begun], 150)
    told = whole.region_sums(table, [model], [0])[0]
    assert told[1:4].min() >= 150 and told[1:4].sum() == 600
    assert np.isclose(model.inertia, told[0], rtol=1e-3)


def test_each_candidate_has_its_own_task(spark):
    for many in (3, 9):
        found = search.fan_out(spark, [{"i": i} for i in range(many)], lambda job: ({"i": job["i"], "at": TaskContext.get().partitionId()}, None))
        assert [m["i"] for m, _ in found] == list(range(many)) and len({m["at"] for m, _ in found}) == many


def test_purities_by_one_look_are_those_of_sorted_distances():
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(700, 2)), rng.integers(0, 6, (700, 2)).astype(float), np.zeros((30, 2)), rng.normal(size=(4, 2))):
        labels = rng.integers(0, 3, len(x))
        d = E.squared(x, x)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")
        found = E.knn_purities(x, labels, [1, 10, 20])
        for k in (1, 10, 20):
            at = near[:, : min(k, len(x) - 1)]
            assert abs(found[k] - (labels[at] == labels[:, None]).mean(1).mean()) < 1e-12 and E.knn_purity(x, labels, k) == found[k]


def test_clusters_are_probed_in_tasks_of_their_own(spark):
    sizes = [900, 1000, 1100, 600]
    df = spark.createDataFrame([(i, float(j)) for i, n in enumerate(sizes) for j in range(n)], "cluster_id int, x double")
    found = micro.apart(df, "cluster_id").groupBy("cluster_id").applyInPandas(lambda f: f.assign(at=TaskContext.get().partitionId())[["cluster_id", "at"]].head(1), "cluster_id int, at int").collect()
    assert len(found) == 4 and len({r["at"] for r in found}) == 4
