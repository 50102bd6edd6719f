"""Finding, reading and writing a run's files."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope import schema
from duoscope.operators import estimators as E
from duoscope.sources import artifacts, discovery, frames, tables


@pytest.fixture
def run(tmp_path):
    """A run's folder with two splits, a tool folder and summaries."""
    for d in ("all", "train", ".git", ".pytest_x"):
        (tmp_path / d).mkdir()
    (tmp_path / "all" / "cluster_assignments.csv").write_text("﻿Identifier,cluster_id\na ,0\nb,1\n", encoding="utf-8")
    (tmp_path / "train" / "cluster_assignments.csv").write_text("identifier,cluster_id\na,0\n")
    (tmp_path / "all" / "canonical_affect_regions.csv").write_text('song_id,"balanced_v",balanced_a,note\na,0.25,0.5,"x,y"\nb,0.75,0.5,z\n')
    (tmp_path / "all" / "tension_micro_probe.csv").write_text("id,tension_subtype,dv,da,norm\na,T0,0.1,0.0,0.1\nb,T1,0.0,0.2,0.2\n")
    (tmp_path / ".git" / "cluster_assignments.csv").write_text("identifier,cluster_id\n")
    (tmp_path / "pipeline_summary.json").write_text('{"selected_k": 4}')
    (tmp_path / "all" / "cluster_search_metrics.csv").write_text("k,score\n4,0.5\n")
    return tmp_path


def test_discovery(spark, run):
    root = str(run)
    found = discovery.csv_files(spark, root)
    assert len(found) == 5 and not any(".git" in p for p in found)
    assert discovery.header(spark, f"{root}/all/canonical_affect_regions.csv") == ["song_id", "balanced_v", "balanced_a", "note"]
    assert discovery.header(spark, f"{root}/all/cluster_assignments.csv")[0] == "Identifier"
    groups = [schema.ALIASES["song_id"], schema.ALIASES["cluster_id"]]
    assert discovery.find(spark, root, groups, ["cluster_assignments.csv"]).endswith("/all/cluster_assignments.csv")
    assert discovery.resolve(spark, None, root, ["cluster_assignments.csv"], groups).endswith("/all/cluster_assignments.csv")
    assert discovery.resolve(spark, None, root, ["none.csv"], [["absent"]], required=False) is None
    for asked in (lambda: discovery.resolve(spark, f"{root}/no.csv", root, [], []), lambda: discovery.resolve(spark, None, root, ["a.csv"], [["absent"]]), lambda: discovery.find(spark, root, [["absent"]], []), lambda: discovery.data_dir(spark, root)):
        with pytest.raises(FileNotFoundError):
            asked()
    score = discovery.RETRIEVAL.score
    assert score("/x/all/selected_a.csv", ["a.csv"]) == 120 - 200 + 80 and score("outputs/a.csv", ["b.csv", "a.csv"]) == 30 + 199 and score(".pytest_1/z.csv", []) == -500
    assert discovery.PROFILE.score("train/a.csv", ["a.csv"]) == 50
    assert discovery.run_summary(spark, root) == {"selected_k": 4} and discovery.run_summary(spark, f"{root}/all") == {}
    assert discovery.split_metrics(spark, root, "cluster_search_metrics.csv").columns == ["k", "score"] and discovery.split_metrics(spark, root, "no.csv") is None
    assert discovery.present(spark, root, ["all", "no"]) == {"all": True, "no": False}


def test_arrays_and_digests(spark, tmp_path):
    np.save(tmp_path / "audio.npy", np.array([[1, 2], [3, 4.5]], np.float32))
    path = f"{tmp_path}/audio.npy"
    assert [tuple(x) for x in discovery.read_array(spark, path, names=["v", "a"]).orderBy("idx").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.5)]
    assert discovery.read_array(spark, f"{tmp_path}/no.npy", required=False) is None and discovery.data_dir(spark, str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        discovery.read_array(spark, f"{tmp_path}/no.npy")
    with pytest.raises(ValueError):
        discovery.read_array(spark, path, names=["v"])
    cache = discovery.ArrayCache(spark)
    assert cache(path) is cache(path)
    cache.clear()
    assert discovery.json_digest({"b": 1, "a": "ü"}) == hashlib.sha256('{"a": "ü", "b": 1}'.encode()).hexdigest()
    assert discovery.file_digest(spark, path) == hashlib.sha256((tmp_path / "audio.npy").read_bytes()).hexdigest()
    (tmp_path / "d.json").write_text('{"s1": {"x": 1}}')
    assert [tuple(x) for x in discovery.keyed_json(spark, f"{tmp_path}/d.json").collect()] == [("s1", '{"x":1}')]
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        discovery.keyed_json(spark, f"{tmp_path}/l.json")


def test_frames_of_a_run(spark, run):
    got = sorted(map(tuple, frames.load_cluster_plane(spark, str(run)).collect()))
    assert got == [("a", 0, 0.25, 0.5), ("b", 1, 0.75, 0.5)]
    assert sorted(map(tuple, frames.load_tension(spark, str(run)).select("song_id", "tension_name", "tension_norm").collect())) == [("a", "T0", 0.1), ("b", "T1", 0.2)]
    ids = spark.createDataFrame([("a", "0"), ("a", "1")], "id string, cluster string")
    plane = spark.createDataFrame([("a", 0.1, 0.2)], "id string, balanced_v double, balanced_a double")
    with pytest.raises(Exception, match="repeats"):
        frames.cluster_plane(ids, plane).collect()
    with pytest.raises(Exception, match="no partner"):
        frames.cluster_plane(spark.createDataFrame([("z", "0")], ids.schema), plane).collect()
    with pytest.raises(Exception, match="no numbers"):
        frames.cluster_plane(ids.limit(1), plane.withColumn("balanced_v", F.lit("x"))).collect()
    with pytest.raises(ValueError):
        frames.id_column(spark.createDataFrame([(1,)], "x int"), ids.select(F.col("id").alias("song_id")))
    with pytest.raises(ValueError):
        frames.aligned_pairs(ids)
    assert frames.cluster_frame(None, spark).count() == frames.tension_frame(None, spark).count() == 0


def test_retrieval_features_fill_and_count_conflicts(spark):
    told = spark.createDataFrame([("a", 2, 0.2, 0.1, 0.6, 0.1, None), ("b", 0, 0.9, 0.0, 0.1, 0.0, "C3 x"), ("a", 1, 1.0, 0.0, 0.0, 0.0, None)], "id string, cluster int, w_region_C0 double, w_region_C1 double, w_region_C2 double, w_region_C3 double, nearest_alt_cluster string")
    cluster = spark.createDataFrame([("a", "C1", 0.3), ("c", "x", 0.4)], "identifier string, cluster string, balanced_v double")
    tension = spark.createDataFrame([("a", 3.0, 4.0), ("b", 0.0, 1.0)], "id string, dv double, da double")
    features, conflicts = frames.retrieval_features(told.coalesce(1), cluster, tension)
    assert features.columns == schema.FEATURES and [tuple(x) for x in conflicts.collect()] == [("cluster", "cluster_id", 1)]
    rows = {x.song_id: x for x in features.collect()}
    a = rows["a"]
    assert (a.cluster_name, a.region_confidence, a.nearest_alt_cluster, a.tension_norm, a.tension_strength_percentile, a.balanced_valence) == ("Volatile Intensity", 0.6, "C0 Subdued Melancholy", 5.0, 1.0, 0.3)
    assert a.region_margin == pytest.approx(0.4) and rows["b"].nearest_alt_cluster == "C3 x" and rows["c"].cluster_name == "missing" and rows["c"].tension_label == "missing"
    missing = {x.feature: x.missing for x in frames.missing_features(features).collect()}
    assert missing["tension_dv"] == 1 and missing["region_typicality"] == 3 and missing["cluster_id"] == 1


def test_artifacts(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(0, "ä", "x,\"y\"", 0, 0.9, 0.9), (1, "b", "z", -1, 0.1, 0.2)], "idx int, audio_id string, lyric_id string, label int, bv double, ba double")
    artifacts.write_csv(df, f"{root}/t")
    text = next((tmp_path / "t").glob("*.csv")).read_bytes()
    assert text.startswith("﻿idx".encode()) and tables.read_csv(spark, f"{root}/t").columns == df.columns
    one, two = artifacts.aligned_tables(df, root)
    assert sorted(r.Quadrant or "" for r in tables.read_csv(spark, one).collect()) == ["", "Q1"] and tables.read_csv(spark, two).count() == 2
    splits = spark.createDataFrame([("train", 0), ("val", 1)], "split string, idx int")
    out = artifacts.write_dataset(df, f"{root}/data", splits, {"scaler": {"m": 1}})
    manifest = artifacts.get_json(spark, out["manifest"])
    assert manifest["rows"] == 2 and manifest["splits"] == {"train": 1, "val": 1} and artifacts.get_json(spark, out["scaler"]) == {"m": 1}
    assert artifacts.patch_json(spark, out["scaler"], {"a": {"b": 1}}) == {"m": 1, "a": {"b": 1}}
    assert artifacts.patch_json(spark, out["scaler"], {"a": {"c": 2}}) == {"m": 1, "a": {"b": 1, "c": 2}}
    names = artifacts.region_names(df.withColumn("cluster_id", F.col("idx")), root)
    assert {r.canonical_name for r in names.collect()} == {"Euphoric Excitement", "Lonely Melancholy"} and (tmp_path / "canonical_affect_regions.md").exists()
    profile = df.select(F.col("audio_id").alias("song_id"), "bv")
    found, missing = artifacts.selected_outputs(profile, spark.createDataFrame([("b",), ("q",)], "identifier string"), root, ["bv"])
    assert [r.song_id for r in found.collect()] == ["b"] and [r.song_id for r in missing.collect()] == ["q"] and artifacts.selected_outputs(profile, None, root)[0].count() == 0
    gates = spark.createDataFrame([("a", "pass", 1.0, ""), ("b", "fail", None, "x")], "gate string, status string, value double, detail string")
    assert artifacts.get_json(spark, artifacts.write_gates(gates, root)["json"])["num_failures"] == 1
    long = spark.createDataFrame([(0, "Genres::rock", 1.0), (1, "Genres::rock", 0.5)], "idx int, feature string, value double")
    assert spark.read.parquet(artifacts.write_features(long, f"{root}/f", df)["vocabulary"]).first().rows == 2
    path = artifacts.report(spark, f"{root}/r.md", "Run", {"mask_nmi": 0.2}, {"T": gates})
    assert "Warning: mask_nmi" in (tmp_path / "r.md").read_text() and path.endswith("r.md")
    files = artifacts.split_outputs(df, f"{root}/all", {"gates": gates}, {"k": 4})
    assert json.loads((tmp_path / "all" / "summary.json").read_text())["output_files"] == files


def test_models_come_back_as_they_were(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (40, 4)) for c in (0.2, 0.8)])
    views, seen = np.stack([x[:, :2], x[:, 2:]]), np.ones((2, 80), bool)
    two = E.TwoLevel(2, [(0, 2), (2, 4)], least=5, starts=2, validator=E.Validator(0.0, 0.0, 10.0)).fit(x)
    for i, (model, use) in enumerate([(E.mixture(x, 2), lambda m: m.predict(x)), (E.latent_mixture(views, seen, 2), lambda m: m.predict(views, seen)), (E.kmeans(x, 2), lambda m: m.predict(x)), (two, lambda m: m.predict(x))]):
        artifacts.save_model(spark, f"file://{tmp_path}/m{i}", model, {"k": 2})
        back, config = artifacts.load_model(spark, f"file://{tmp_path}/m{i}")
        assert (use(back) == use(model)).all() and config == {"k": 2}
    (tmp_path / "m0" / "parameters.json").write_text("{}")
    for crc in (tmp_path / "m0").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="manifest"):
        artifacts.load_model(spark, f"file://{tmp_path}/m0")


def test_paper_and_run_tables(spark, tmp_path):
    a = spark.createDataFrame([("a", "0", "A", "0.1", "0.2"), ("b", "0", "A", "0.2", "0.2"), ("c", "1", "B", "0.9", "0.9")], "identifier string, cluster_id string, artist string, balanced_valence string, balanced_arousal string")
    t = spark.createDataFrame([("a", "0", "0.5"), ("c", "0", "0.1")], "identifier string, cluster_id string, tension_norm string")
    artifacts.write_csv(a, f"{tmp_path}/all/cluster_assignments")
    assert list(artifacts.run_tables(str(tmp_path), spark)) == ["assignments"]
    out = artifacts.paper_tables(a, t)
    assert out["rows"].count() == 3 and [r.identifier for r in out["tension"].collect()] == ["a"] and out["representatives"].filter("cluster_id = '0'").count() == 1
