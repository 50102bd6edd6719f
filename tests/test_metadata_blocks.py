"""Sparse metadata blocks and their truncated SVD against numpy; hypergeometric tails of large groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.operators import metadata, statistics

FIELDS = {"Genres": "genres", "MoodsAll": "moods", "Themes": "themes"}
WEIGHTS = {"Genres": 0.25, "MoodsAll": 0.70, "Themes": 0.0}


def table(spark):
    rows = [("a", "Rock", "Aggressive, Energetic, aggressive", "Action", 3.0), ("b", "Rock", "Aggressive", "Conflict", 1.0), ("c", "Folk", "Reflective, Warm", "Love", None), ("d", "Folk, Rock", "Reflective", None, 2.0), ("e", None, "", None, 4.0)]
    return spark.createDataFrame(rows, "id string, genres string, moods string, themes string, year double")


def dense(block, order):
    features = {r.feature: r.column for r in block.features.collect()}
    out = np.zeros((len(order), len(features)))
    for r in block.entries.collect():
        assert features[r.feature] == r.column
        out[order.index(r.id), r.column] = r.value
    return out, sorted(features, key=features.get)


def test_token_blocks_by_field(spark):
    df, order = table(spark), list("abcde")
    binary, names = dense(metadata.token_blocks(df, "id", FIELDS, WEIGHTS, representation="binary"), order)
    assert names[:2] == ["Genres::rock", "Genres::folk"] and {n.split("::")[0] for n in names} == set(FIELDS)
    assert binary[0, names.index("MoodsAll::aggressive")] == 1 and binary.sum(0)[names.index("Genres::rock")] == 3
    block = metadata.token_blocks(df, "id", FIELDS, WEIGHTS)
    got, again = dense(block, order)
    weight = np.array([WEIGHTS[n.split("::")[0]] for n in names])
    raw = binary * (np.log((1 + 5) / (1 + binary.sum(0))) + 1) * weight
    length = np.sqrt((raw**2).sum(1, keepdims=True))
    assert again == names and np.allclose(got, np.divide(raw, length, out=np.zeros_like(raw), where=length > 0))
    assert {r.id: (r.has_any, round(r.completeness, 6)) for r in block.coverage.collect()}["e"] == (False, 0.0)
    assert {r.id: round(r.completeness, 6) for r in block.coverage.collect()}["d"] == round(2 / 3, 6)
    assert metadata.token_blocks(df, "id", {"Genres": "genres"}, most=1).features.count() == 1
    told = {(r.id, r.feature) for r in metadata.features_with_numbers(df, "id", {"Genres": "genres"}, ["year"]).collect()}
    assert ("a", "Genres::rock") in told and {k for k, f in told if f == "year"} == set(order)


def test_svd_is_that_of_numpy(spark):
    rng = np.random.default_rng(3)
    centre = rng.random((6, 40))
    rows = []
    for i in range(400):
        kind = rng.dirichlet(np.full(6, 0.3))
        rows.append((i, ",".join(f"t{j}" for j in np.flatnonzero(rng.random(40) < 0.5 * (kind @ centre) ** 2 + 0.02))))
    df = spark.createDataFrame(rows, "id long, tokens string").repartition(5)
    found, block, reduction = metadata.represented(df, "id", {"T": "tokens"}, to=5)
    packed = metadata.packed_rows(df, "id", block.entries)
    width = block.features.count()
    a = np.zeros((400, width))
    for r in packed.collect():
        a[r.id, r.columns] = r["values"]
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(reduction.singular, s[:5], rtol=1e-2)
    exact = metadata.truncated_svd(packed, width, 5, passes=40)
    assert np.allclose(exact.singular, s[:5], rtol=1e-9) and np.allclose(np.abs((exact.components * v[:5].T).sum(0)), 1, atol=1e-6)
    got = np.array([list(r)[1:] for r in found.orderBy("id").collect()])
    assert np.allclose(got, a @ reduction.components, atol=1e-9) and found.columns[1:] == [f"metadata_svd_{i:03d}" for i in range(5)]


def test_svd_of_few_columns_and_what_is_refused(spark):
    df = table(spark)
    rows, block, _ = metadata.represented(df, "id", {"Genres": "genres"}, to=4)
    got = {r.id: [r[f"metadata_svd_{i:03d}"] for i in range(4)] for r in rows.collect()}
    assert got["a"] == [1.0, 0, 0, 0] and got["e"] == [0.0] * 4 and got["c"][1] == 1.0
    for bad in (lambda: metadata.represented(df, "id", FIELDS, "words"), lambda: metadata.token_blocks(df, "id", FIELDS, representation="x"), lambda: metadata.truncated_svd(df, metadata.MOST_WIDTH + 1, 2)):
        with pytest.raises(ValueError):
            bad()


def test_tails_of_large_groups_make_no_rows(spark):
    """Against sums of exact terms, from far below the mode to far above it."""
    base = spark.range(3000).select(F.col("id"), (F.col("id") < 1100).cast("int").alias("g"), F.explode(F.when(F.col("id") % 5 == 0, F.array(F.lit("t"), F.lit("u"))).when(F.col("id") < 700, F.array(F.lit("u"))).otherwise(F.array(F.lit("rest")))).alias("token"))
    found = statistics.enrichment(base, "id", "g", "token")
    assert "Generate" not in found.select("p")._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    counts = {}
    for r in base.collect():
        counts.setdefault((r.g, r.token), set()).add(r.id)
    of = {t: sum(len(v) for (g, u), v in counts.items() if u == t) for t in ("t", "u", "rest")}
    size = {1: 1100, 0: 1900}
    for r in found.collect():
        k, o, s = len(counts[r.g, r.token]), of[r.token], size[r.g]
        want = sum(math.comb(o, x) * math.comb(3000 - o, s - x) for x in range(k, min(o, s) + 1)) / math.comb(3000, s)
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-300), (r.g, r.token)
