"""Finding a run's tables by their headers, on the driver: paths are listed by Hadoop, so any store works.

A candidate satisfies all groups of column names that are asked for; the best is the one of the highest score by its
name and folders, then the shallowest, then the last in the order of paths. Only header lines are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import find_column, script_form
from .tables import read_csv

SKIPPED = (".git", "__pycache__", ".ruff_cache")
SKIPPED_PREFIXES = (".pytest", "..pytest")


@dataclass(frozen=True)
class Ranking:
    """What a path scores by."""

    all_folder: int
    all_name: int
    selected_name: int
    outputs_folder: int
    test_folder: int
    split_folder: int
    exact: int
    partial: int

    def score(self, path: str, preferred: Sequence[str]) -> int:
        *folders, name = [p.lower() for p in path.replace("\\", "/").split("/") if p]
        parts = [*folders, name]
        out = self.all_folder * ("all" in parts) + self.all_name * ("all" in name) + self.selected_name * ("selected" in name)
        out += self.outputs_folder * any(p in ("outputs", "output_final") for p in parts) + self.test_folder * any(p.startswith(".pytest") for p in parts)
        out += self.split_folder * any(p in ("train", "val", "test") for p in parts)
        for i, wanted in enumerate(w.lower() for w in preferred):
            if name == wanted:
                out += self.exact - i
            elif wanted.replace(".csv", "") in name:
                out += self.partial - i
        return out


# Scores of the retrieval's and of the profile's search.
RETRIEVAL = Ranking(120, 80, -200, 30, -500, 0, 200, 80)
PROFILE = Ranking(200, 0, 0, 0, 0, -50, 100, 30)


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def csv_files(spark: SparkSession, root: str) -> list[str]:
    """All CSV files below a folder; folders of tools are left out. An absent folder has none."""
    fs, top = _fs(spark, root)
    found, todo = [], [top] if fs.exists(top) else []
    while todo:
        for s in fs.listStatus(todo.pop()):
            name = s.getPath().getName()
            if s.isDirectory():
                if name not in SKIPPED and not name.startswith(SKIPPED_PREFIXES):
                    todo.append(s.getPath())
            elif name.lower().endswith(".csv"):
                found.append(s.getPath().toString())
    return sorted(found)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names alone; [] for a file that has none."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    line = spark.createDataFrame([(first[0].value.removeprefix("﻿"),)], "line string")
    width = len(first[0].value.split(","))
    fields = ", ".join(f"c{i} string" for i in range(width))
    got = line.select(F.from_csv("line", fields).alias("r")).select("r.*").first()
    return [v.strip() for v in got if v is not None]


def has_columns(spark: SparkSession, path: str, groups: Sequence[Sequence[str]]) -> bool:
    columns = header(spark, path)
    return all(find_column(columns, g, script_form) is not None for g in groups)


def best(paths: Sequence[str], preferred: Sequence[str], ranking: Ranking) -> str:
    return max(paths, key=lambda p: (ranking.score(p, preferred), -len(p.split("/")), p))


def resolve(spark: SparkSession, explicit: str | None, root: str, preferred: Sequence[str], groups: Sequence[Sequence[str]], required: bool = True, generic: bool = True, folders: Sequence[str] = ("", "all", "output_final/all"), ranking: Ranking = RETRIEVAL) -> str | None:
    """The explicit path; else the best preferred name in the usual folders; else the best file below root; else None or FileNotFoundError."""
    if explicit:
        if not exists(spark, explicit):
            raise FileNotFoundError(explicit)
        return explicit
    direct = ["/".join(x for x in (root.rstrip("/"), f, n) if x) for n in preferred for f in folders]
    found = [p for p in direct if exists(spark, p) and has_columns(spark, p, groups)]
    if not found and generic:
        found = [p for p in csv_files(spark, root) if has_columns(spark, p, groups)]
    if found:
        return best(found, preferred, ranking)
    if required:
        raise FileNotFoundError(f"no CSV file below {root} is like {list(preferred)} and has the columns")
    return None


def find(spark: SparkSession, run_dir: str, groups: Sequence[Sequence[str]], preferred: Sequence[str]) -> str:
    """The best file of a run's folder by the profile's ranking."""
    found = [p for p in csv_files(spark, run_dir) if has_columns(spark, p, groups)]
    if not found:
        raise FileNotFoundError(f"no CSV file below {run_dir} has columns of {[list(g) for g in groups]}")
    return best(found, preferred, PROFILE)


def first_that_exists(spark: SparkSession, folder: str, names: Sequence[str]) -> str | None:
    """The first of the names below a folder."""
    return next((p for n in names if exists(spark, p := f"{folder.rstrip('/')}/{n}")), None)


def data_dir(spark: SparkSession, path: str) -> str:
    """A dataset's folder: the path itself or its `music` subfolder, whichever holds the first array."""
    for folder in (path.rstrip("/"), f"{path.rstrip('/')}/music"):
        if exists(spark, f"{folder}/audio.npy"):
            return folder
    raise FileNotFoundError(f"no audio.npy in {path} or its music folder")


def read_text(spark: SparkSession, path: str) -> str:
    found = spark.read.text(path, wholetext=True).first()
    return found.value if found else ""  # an empty file has no row


def run_summary(spark: SparkSession, run_dir: str) -> dict:
    """The rerun's summary, else the pipeline's, else {}."""
    path = first_that_exists(spark, run_dir, ["rerun_summary.json", "pipeline_summary.json"])
    found = json.loads(read_text(spark, path)) if path else {}
    return found if isinstance(found, dict) else {}


def split_metrics(spark: SparkSession, run_dir: str, name: str, splits: Sequence[str] = ("train", "all")) -> DataFrame | None:
    """A metrics table of the first split that has it (search metrics: train, all; audits: all, train, val, test); None without."""
    path = first_that_exists(spark, run_dir, [f"{s}/{name}" for s in splits])
    return read_csv(spark, path) if path else None


def present(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, bool]:
    """Which artifacts are there."""
    return {n: exists(spark, f"{folder.rstrip('/')}/{n}") for n in names}


def keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, body) of a JSON object keyed by id; anything else is a ValueError."""
    if not isinstance(json.loads(read_text(spark, path)), dict):
        raise ValueError(f"{path} is no JSON object")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("song_id", "body"))


# ---------------------------------------------------------------- arrays and digests


def read_array(spark: SparkSession, path: str, required: bool = True, names: Sequence[str] = (), key: str = "idx") -> DataFrame | None:
    """A .npy matrix as a table of its row number and columns, read by ranges; FileNotFoundError, or None, where it is absent."""
    from .arrays import header, read_npy

    if not exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return None
    if names and header(path).width != len(names):
        raise ValueError(f"{path} has {header(path).width} columns, not {len(names)}")
    return read_npy(spark, path, names, key=key)


class ArrayCache:
    """Arrays by path, read once and persisted; clear() lets go of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held = lru_cache(None)(lambda path: read_array(spark, path).persist())
        self._paths: list[str] = []

    def __call__(self, path: str) -> DataFrame:
        self._paths.append(path)
        return self._held(path)

    def clear(self) -> None:
        for path in dict.fromkeys(self._paths):
            self._held(path).unpersist()
        self._held.cache_clear()
        self._paths = []


def json_digest(value: object) -> str:
    """SHA-256 of canonical JSON: keys sorted, characters as they are, other values as text."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first().h
