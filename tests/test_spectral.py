"""Spectral regions of shapes that nearest centres can't part."""

import numpy as np
from pyspark.sql import functions as F

from duoscope.operators import estimators as E
from duoscope.operators import spectral


def rings(n=400, seed=0):
    rng = np.random.default_rng(seed)
    turn = rng.uniform(0, 2 * np.pi, 2 * n)
    far = np.where(np.arange(2 * n) < n, 1.0, 3.0) + rng.normal(0, 0.08, 2 * n)
    return np.stack([far * np.cos(turn), far * np.sin(turn)], 1), (np.arange(2 * n) >= n).astype(int)


def test_two_rings_are_parted(spark):
    x, y = rings()
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame([*rows, (9000, None, 1.0), (9001, float("nan"), 1.0)], "idx long, x double, y double").withColumn("more", F.lit("kept"))
    got = {r.idx: r.cluster_id for r in spectral.spectral_regions(df.repartition(4), ["x", "y"], 2, many=120, sample=500).collect()}
    assert got[9000] == got[9001] == -1 and E.rand_index(np.array([got[i] for i in range(len(x))]), y) > 0.99
    assert E.rand_index(E.kmeans(x, 2).labels, y) < 0.2


def test_shares_and_directions_in_memory():
    x, y = rings(200)
    marks = spectral.landmarks(x, 100)
    z = marks.dense(x)
    assert np.allclose(z.sum(1), 1) and ((z > 0).sum(1) <= spectral.NEAR).all()
    few = spectral.landmarks(np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 1.0]]), 100)
    assert len(few.places) == 2 and np.allclose(few.dense(np.array([[0.0, 0.0]])).sum(), 1)
