"""What a run leaves behind: tables as Parquet or CSV folders, small JSON and Markdown files, parameters of models.

Tables are written by the executors; only files of a summary's size are made on the driver. All go through Hadoop's
file systems, so any store works."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimators, reports, selection
from ..operators.joins import missing_keys
from .discovery import exists, read_text
from .frames import id_column, song_id
from .tables import markdown, read_csv

BOM = "﻿"


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """Writes a small UTF-8 file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return path


def put_json(spark: SparkSession, path: str, value: object) -> str:
    return put_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str))


def get_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def write_csv(df: DataFrame, path: str, bom: bool = True) -> str:
    """A folder of CSV files with a header each, in UTF-8 with a byte-order mark by default."""
    marked = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df
    marked.write.option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)
    return path


def aligned_tables(df: DataFrame, root: str, audio: str = "audio_id", lyric: str = "lyric_id", label: str = "label") -> list[str]:
    """Two tables of one form, ids and quadrant names, one for either view."""
    names = F.when(F.col(label) >= 0, F.concat(F.lit("Q"), (F.col(label) + 1).cast("string"))).otherwise("")
    table = df.select(F.col(audio).alias("Audio_Song"), F.col(lyric).alias("Lyric_Song"), names.alias("Quadrant"))
    return [write_csv(table, f"{root}/{view}_metadata") for view in ("audio", "lyrics")]


def write_dataset(df: DataFrame, root: str, splits: DataFrame, extra: dict[str, dict] | None = None, key: str = "idx") -> dict[str, str]:
    """The dataset as Parquet, its splits, and sidecars with its columns, counts and digests."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/rows")
    splits.write.mode("overwrite").parquet(f"{root}/splits")
    counts = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}  # a row a split
    manifest = {"rows": df.count(), "columns": df.columns, "splits": counts, "key": key, "schema": json.loads(df.schema.json())}
    out = {"rows": f"{root}/rows", "splits": f"{root}/splits", "manifest": put_json(spark, f"{root}/manifest.json", manifest)}
    for name, value in (extra or {}).items():
        out[name] = put_json(spark, f"{root}/{name}.json", value)
    return out


def write_features(long: DataFrame, root: str, canonical: DataFrame) -> dict[str, str]:
    """A feature bundle: (key, feature, value) rows, the vocabulary (feature, field, rows), and the canonical metadata."""
    long.write.mode("overwrite").parquet(f"{root}/values")
    vocabulary = long.groupBy("feature").agg(F.count("*").alias("rows")).withColumn("field", F.substring_index("feature", "::", 1))
    vocabulary.write.mode("overwrite").parquet(f"{root}/vocabulary")
    write_csv(canonical, f"{root}/canonical_metadata")
    return {"values": f"{root}/values", "vocabulary": f"{root}/vocabulary", "canonical": f"{root}/canonical_metadata"}


def selected_outputs(profile: DataFrame, selected: DataFrame | None, root: str, columns: Sequence[str] = (), key: str = "song_id") -> tuple[DataFrame, DataFrame]:
    """(profiles of the selected ids, ids that have none), written with a JSON text of each found row's descriptors."""
    spark = profile.sparkSession
    if selected is None:
        return profile.limit(0), spark.createDataFrame([], f"{key} string")
    ids = selected.select(song_id(F.col(id_column(selected, profile.select(F.col(key).alias("song_id"))))).alias(key)).distinct()
    found, missing = profile.join(ids, key, "left_semi"), missing_keys(ids, profile, key)
    write_csv(found, f"{root}/song_affective_profile_selected")
    write_csv(missing, f"{root}/missing_selected_songs")
    told = [c for c in columns if c in found.columns]
    found.select(key, F.to_json(F.struct(*told)).alias("descriptors")).write.mode("overwrite").parquet(f"{root}/descriptor_weights_selected")
    return found, missing


def region_names(df: DataFrame, root: str, cluster: str = "cluster_id", v: str = "bv", a: str = "ba", tokens: DataFrame | None = None) -> DataFrame:
    """(cluster, centre, size, canonical_name), written as CSV and Markdown."""
    table = df.groupBy(cluster).agg(F.avg(v).alias("balanced_valence"), F.avg(a).alias("balanced_arousal"), F.count("*").alias("size"))
    hint = None
    if tokens is not None:
        table = table.join(tokens, cluster, "left")
        hint = F.coalesce("top_tokens", F.lit(""))
    table = table.withColumn("canonical_name", selection.region_name(F.col("balanced_valence"), F.col("balanced_arousal"), F.col(cluster), hint))
    write_csv(table, f"{root}/canonical_affect_regions")
    put_text(df.sparkSession, f"{root}/canonical_affect_regions.md", markdown(table.orderBy(cluster), 1000))
    return table


def macro_micro_tables(labelled: DataFrame, enrichment: DataFrame, root: str, macro: str = "macro_id") -> dict[str, str]:
    """Sizes by macro and micro cluster, and each macro cluster's enrichment in a folder of its own."""
    summary = labelled.groupBy(macro, "micro_id").agg(F.count("*").alias("size"))
    write_csv(summary, f"{root}/macro_micro_summary")
    enrichment.write.mode("overwrite").partitionBy(macro).parquet(f"{root}/macro_micro")
    return {"summary": f"{root}/macro_micro_summary", "enrichment": f"{root}/macro_micro"}


def alpha_report(scores: DataFrame, chosen: float, root: str) -> str:
    """The search for the views' balance, with the chosen row marked."""
    return write_csv(scores.withColumn("selected", F.col("alpha") == chosen), f"{root}/balance_alpha_report")


def split_outputs(df: DataFrame, root: str, tables: dict[str, DataFrame], summary: dict) -> dict[str, str]:
    """All tables of a split below its folder, with a summary that lists them."""
    out = {"assignments": write_csv(df, f"{root}/cluster_assignments")}
    for name, table in tables.items():
        out[name] = write_csv(table, f"{root}/{name}")
    put_json(df.sparkSession, f"{root}/summary.json", summary | {"output_files": out})
    return out


# ---------------------------------------------------------------- parameters


def _plain(value: object) -> object:
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "kind": str(value.dtype)}
    if is_dataclass(value) and not isinstance(value, type):
        own = {f.name for f in fields(value)} | {k for k in vars(value)}
        return {"model": type(value).__name__, "values": {k: _plain(getattr(value, k)) for k in sorted(own)}}
    if isinstance(value, dict):
        return {"map": [[_plain(k), _plain(v)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return {"list": [_plain(v) for v in value]}
    return value.item() if isinstance(value, np.generic) else value


_MODELS = {c.__name__: c for c in (estimators.Diagonal, estimators.Latent, estimators.Partition, estimators.TwoLevel, estimators.Validator)}


def _model(value: object) -> object:
    if isinstance(value, dict):
        if "array" in value:
            return np.array(value["array"], dtype=value["kind"])
        if "model" in value:
            out = object.__new__(_MODELS[value["model"]])
            out.__dict__.update({k: _model(v) for k, v in value["values"].items()})
            return out
        if "map" in value:
            return {_model(k): _model(v) for k, v in value["map"]}
        return [_model(v) for v in value["list"]]
    return value


def save_model(spark: SparkSession, path: str, model: object, config: dict | None = None) -> str:
    """Parameters as JSON (no pickles) beside a digest of them and the configuration; returns the digest."""
    body = json.dumps(_plain(model), sort_keys=True)
    digest = hashlib.sha256(body.encode()).hexdigest()
    put_text(spark, f"{path}/parameters.json", body)
    put_json(spark, f"{path}/manifest.json", {"version": 2, "sha256": digest, "config": config or {}})
    return digest


def load_model(spark: SparkSession, path: str) -> tuple[object, dict]:
    """(model, configuration); ValueError for another version or where the digest does not fit."""
    manifest, body = get_json(spark, f"{path}/manifest.json"), read_text(spark, f"{path}/parameters.json")
    if manifest.get("version") != 2:
        raise ValueError(f"{path} is of version {manifest.get('version')}")
    if hashlib.sha256(body.encode()).hexdigest() != manifest["sha256"]:
        raise ValueError(f"the parameters in {path} are not those of its manifest")
    return _model(json.loads(body)), manifest["config"]


# ---------------------------------------------------------------- reports


def write_gates(gates: DataFrame, root: str) -> dict[str, str]:
    """The audit as JSON and Markdown."""
    rows = [r.asDict() for r in gates.collect()]  # a row a gate
    ready = not any(r["status"] == "fail" for r in rows)
    spark = gates.sparkSession
    told = put_json(spark, f"{root}/audit.json", {"overall_ready": ready, "num_failures": sum(r["status"] == "fail" for r in rows), "gates": {r["gate"]: r for r in rows}})
    return {"json": told, "markdown": put_text(spark, f"{root}/audit.md", f"# Audit\n\nReady: {'yes' if ready else 'no'}\n\n{markdown(gates, 100)}\n")}


def patch_json(spark: SparkSession, path: str, changes: dict) -> dict:
    """A JSON object with some keys set anew, objects key by key; written in place and returned."""

    def merged(old: object, new: object) -> object:
        return {**old, **{k: merged(old.get(k), v) for k, v in new.items()}} if isinstance(old, dict) and isinstance(new, dict) else new

    out = merged(get_json(spark, path) if exists(spark, path) else {}, changes)
    put_json(spark, path, out)
    return out


def report(spark: SparkSession, path: str, title: str, facts: dict, tables: dict[str, DataFrame], limit: int = 20) -> str:
    """A Markdown report: facts, warnings about what is missing, and the first rows of tables."""
    lines = [f"# {title}", "", *(f"- {k}: **{v}**" for k, v in facts.items())]
    warned = [f"- Warning: {k} is {facts[k]:.3f}" for k, bad in (("pair_share", lambda v: v < 0.15), ("lyrics_share", lambda v: v < 0.15), ("mask_nmi", lambda v: v > 0.15)) if isinstance(facts.get(k), float) and bad(facts[k])]
    lines += ["", "## Missing data", "", *warned] if warned else []
    for name, table in tables.items():
        lines += ["", f"## {name}", "", markdown(table, limit)]
    return put_text(spark, path, "\n".join(lines) + "\n")


def retrieval_report(spark: SparkSession, path: str, rankings: DataFrame, metrics: DataFrame, features: DataFrame) -> str:
    """Rankings, metrics and missing features of a retrieval run."""
    from .frames import missing_features

    counts = rankings.groupBy("query_id", "system").agg(F.count("*").alias("rows"))
    return report(spark, path, "Retrieval evaluation", {"songs": features.count(), "queries": rankings.select("query_id").distinct().count()}, {"Rankings": counts.orderBy("query_id", "system"), "Metrics": metrics.orderBy("query_id", "system", "k"), "Missing features": missing_features(features).orderBy("feature")}, 100)


def run_tables(run_dir: str, spark: SparkSession) -> dict[str, DataFrame]:
    """The tables that reports are compiled from: assignments, tension subtypes and regions, as far as they are there."""
    names = {"assignments": "all/cluster_assignments", "tension": "all/tension_subtype_assignments", "regions": "all/canonical_affect_regions", "catalog": "all/affect_catalog"}
    return {k: read_csv(spark, f"{run_dir}/{p}") for k, p in names.items() if exists(spark, f"{run_dir}/{p}")}


def paper_tables(assignments: DataFrame, tension: DataFrame, key: str = "identifier") -> dict[str, DataFrame]:
    """Tables of a paper: rows with their subtype by (id, cluster), representatives of each cluster, and those of highest tension."""
    met = assignments.join(tension.select(key, "cluster_id", *(c for c in tension.columns if c not in assignments.columns)), [key, "cluster_id"], "left")
    numbers = met.withColumns({c: F.col(c).cast("double") for c in ("balanced_valence", "balanced_arousal")})
    first = selection.representatives(numbers, 5, "balanced_valence", "balanced_arousal", "cluster_id", "artist", key)
    strong = met.withColumn("tension_norm", F.col("tension_norm").cast("double")).filter("tension_norm is not null").orderBy(F.desc("tension_norm"), key).limit(200)  # the limit is the feature
    return {"rows": met, "representatives": first, "tension": strong, "sizes": reports.label_counts(met, ["cluster_id"])}
