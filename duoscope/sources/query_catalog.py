"""A user's own catalogue of declarative queries, from a YAML or JSON file, as the table that retrieval ranks by.

A file is a list of queries, or an object whose `queries` is one. Of a query are read: query_id; target_cluster (C0 to C3, a
number, or any); target_va (a region of the plane, for queries without a cluster); target_tension_direction (dv and da, each
positive or negative); target_tension_strength, target_complexity, target_region_role and target_region_mixture. Other fields
are descriptions. A file that is absent, can't be parsed, has no queries or repeats an id is an error.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.retrieval import QUERIES, QUERY_SCHEMA
from .artifacts import put_text
from .discovery import exists, read_text

# Regions of the plane by name, and directions by word.
PLANE = {"low_valence_low_arousal": 0, "mid_positive_low_arousal": 1, "low_valence_high_arousal": 2, "high_valence_high_arousal": 3}
DIRECTIONS = {"positive": 1.0, "+": 1.0, "negative": -1.0, "-": -1.0}


def parsed(text: str) -> list[dict]:
    """The queries of a file's text: JSON, else YAML where its parser is installed."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the file is no JSON, and no parser of YAML is installed") from e
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"the file is neither JSON nor YAML: {e}") from e
    found = found.get("queries") if isinstance(found, dict) else found
    if not isinstance(found, list) or not found or not all(isinstance(q, dict) for q in found):
        raise ValueError("a catalogue is a list of queries")
    return found


def region(value: object) -> int:
    """The number of a region, -1 for any."""
    text = str("" if value is None else value).strip().lower()
    if text in ("", "any", "none"):
        return -1
    number = re.search(r"\d+", text)
    if not number:
        raise ValueError(f"{value!r} is no region")
    return int(number[0])


def as_row(query: dict) -> tuple:
    name = str(query.get("query_id") or "").strip()
    if not name:
        raise ValueError("a query has no query_id")
    target = region(query.get("target_cluster"))
    plane = target if target >= 0 else PLANE.get(str(query.get("target_va") or "").strip(), -1)
    way = query.get("target_tension_direction") or {}
    if not isinstance(way, dict):
        raise ValueError(f"{name}: a direction has dv and da")
    dv, da = (DIRECTIONS.get(str(way.get(c, "")).strip().lower(), 0.0) for c in ("dv", "da"))
    text = lambda c: str(query.get(c) or "").strip()
    return (name, target, dv, da, text("target_tension_strength"), text("target_complexity"), text("target_region_role"), text("target_region_mixture"), plane)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """The table of a file's queries, for retrieval.scores() and runs.retrieve()."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = [as_row(q) for q in parsed(read_text(spark, path).removeprefix("﻿"))]
    names = [r[0] for r in rows]
    if repeated := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"queries repeat: {', '.join(sorted(repeated))}")
    return spark.createDataFrame(rows, QUERY_SCHEMA)


def write_queries(spark: SparkSession, path: str) -> str:
    """The built-in catalogue as a file to edit; JSON, which is YAML too."""
    word = {1.0: "positive", -1.0: "negative"}
    out = []
    for name, target, dv, da, strength, complexity, role, mixture in QUERIES:
        way = {c: word[v] for c, v in (("dv", dv), ("da", da)) if v}
        fields = {"target_tension_direction": way, "target_tension_strength": strength, "target_complexity": complexity, "target_region_role": role, "target_region_mixture": mixture}
        out.append({"query_id": name, "target_cluster": f"C{target}" if target >= 0 else "any"} | {k: v for k, v in fields.items() if v})
    return put_text(spark, path, json.dumps({"queries": out}, indent=2) + "\n")
