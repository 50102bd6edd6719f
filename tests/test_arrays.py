"""Matrices in .npy files, by ranges and by tasks."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.sources import arrays


def matrix(df):
    return np.array([list(r)[1:] for r in df.orderBy("idx").collect()])


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<i2", "|b1"])
def test_files_are_read_by_ranges(spark, tmp_path, order, dtype):
    x = np.asarray(np.random.default_rng(0).integers(0, 2 if dtype == "|b1" else 100, (1000, 3)), dtype, order=order)
    np.save(tmp_path / "x.npy", x)
    arrays.register(spark)
    df = spark.read.format("npy").option("rangeBytes", 4096).load(f"{tmp_path}/x.npy")
    assert df.columns == ["idx", "x0", "x1", "x2"] and df.rdd.getNumPartitions() == -(-1000 // (4096 // (3 * np.dtype(dtype).itemsize)))
    assert (matrix(df) == x.astype(float)).all()
    some = spark.read.format("npy").options(rangeBytes=4096, names="a,b,c", columns="c,a").load(f"file://{tmp_path}/x.npy")
    assert some.columns == ["idx", "c", "a"] and (matrix(some) == x[:, [2, 0]].astype(float)).all()
    few = df.filter("idx >= 500 and idx < 510")
    assert (matrix(few) == x[500:510].astype(float)).all() and few.rdd.getNumPartitions() == 1
    assert df.filter("idx = 7 and x0 >= 0").count() == 1 and df.filter("idx > 998").count() == 1 and df.filter("idx <= 1").count() == 2 and df.filter("idx > 5000").count() == 0


def test_odd_shapes_and_what_is_refused(spark, tmp_path):
    np.save(tmp_path / "line.npy", np.arange(5.0))
    np.save(tmp_path / "cube.npy", np.arange(24.0).reshape(2, 3, 4))
    np.save(tmp_path / "none.npy", np.zeros((0, 2)))
    assert matrix(arrays.read_npy(spark, f"{tmp_path}/line.npy")).tolist() == [[float(i)] for i in range(5)]
    assert matrix(arrays.read_npy(spark, f"{tmp_path}/cube.npy")).tolist() == np.arange(24.0).reshape(2, 12).tolist()
    assert arrays.read_npy(spark, f"{tmp_path}/none.npy").count() == 0
    np.save(tmp_path / "objects.npy", np.array(["a", 1], object))
    with pytest.raises(ValueError):
        arrays.header(f"{tmp_path}/objects.npy")
    for options in ({"names": ["a"]}, {"columns": ["z"]}):
        with pytest.raises(Exception, match="columns"):
            arrays.read_npy(spark, f"{tmp_path}/cube.npy", **options).collect()
    short = Path(tmp_path / "line.npy").read_bytes()[:-8]
    Path(tmp_path / "short.npy").write_bytes(short)
    with pytest.raises(Exception, match="too soon"):
        arrays.read_npy(spark, f"{tmp_path}/short.npy").collect()


def test_a_table_goes_through_arrays_whole(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), (F.col("id") / 3).alias("a"), F.when(F.col("id") % 10 != 0, F.col("id")).alias("b"), F.lit("x").alias("idx"))
    path = f"{tmp_path}/matrix"
    arrays.write_npy(df.repartition(7), path, "k", ["a", "b"], "<f8")
    got = {r.idx: (r.a, r.b) for r in arrays.read_npy(spark, path).collect()}
    want = {r.k: (r.a, float("nan") if r.b is None else float(r.b)) for r in df.collect()}
    assert len(got) == 5000 and all(got[k][0] == a and (got[k][1] == b or b != b) for k, (a, b) in want.items())
    told = json.loads(Path(path, "manifest.json").read_text())
    assert told["rows"] == 5000 and told["columns"] == ["a", "b"]
    parts = np.concatenate([np.load(Path(path, f["file"])) for f in told["files"]])
    assert parts.shape == (5000, 2) and parts[17, 0] == want[17][0]
    Path(path, "part-00000-left-by-a-lost-task.npy").write_bytes(b"x")
    assert arrays.read_npy(spark, path).count() == 5000
    with pytest.raises(Exception, match="already"):
        arrays.write_npy(df, path, "k", ["a"])
    arrays.write_npy(df.filter("k < 10"), path, "k", ["a"], mode="overwrite")
    assert arrays.read_npy(spark, path).count() == 10 and arrays.read_npy(spark, path).columns == ["idx", "a"]


def test_a_write_that_fails_leaves_no_matrix(spark, tmp_path):
    bad = spark.range(100).select("id", F.when(F.col("id") == 60, F.raise_error(F.lit("no")).cast("double")).otherwise(1.0).alias("a")).repartition(4)
    with pytest.raises(Exception):
        arrays.write_npy(bad, f"{tmp_path}/bad", "id", ["a"])
    assert not Path(tmp_path, "bad", "manifest.json").exists()
