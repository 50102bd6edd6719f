"""Catalogues of queries from files."""

import json

import pytest

from duoscope.operators import retrieval, runs
from duoscope.plans.adapters import song
from duoscope.plans.catalog import interpreted
from duoscope.sources import query_catalog

SF = "/root/testdata/sf0.001"
YAML = """queries:
  - query_id: "quiet"
    description: "somewhere quiet"
    target_cluster: "any"
    target_va: "mid_positive_low_arousal"
    target_tension_direction:
      dv: "positive"
    target_tension_strength: "low"
  - query_id: loud
    target_cluster: C2
    target_tension_direction: {da: "-"}
    target_complexity: high
"""


def test_built_in_queries_go_through_a_file(spark, tmp_path):
    path = query_catalog.write_queries(spark, f"{tmp_path}/queries.json")
    got = [tuple(r) for r in query_catalog.read_queries(spark, path).collect()]
    assert got == [tuple(r) for r in retrieval.query_table(spark).collect()] and len(got) == 6


def test_yaml_and_what_is_refused(spark, tmp_path):
    (tmp_path / "q.yaml").write_text("﻿" + YAML, encoding="utf-8")
    got = [tuple(r) for r in query_catalog.read_queries(spark, f"{tmp_path}/q.yaml").collect()]
    assert got == [("quiet", -1, 1.0, 0.0, "low", "", "", "", 1), ("loud", 2, 0.0, -1.0, "", "high", "", "", 2)]
    for i, bad in enumerate(["", "a: [", "queries: []", "- 1", "- target_cluster: C1", "- {query_id: a, target_cluster: here}", "- {query_id: a}\n- {query_id: a}", "- {query_id: a, target_tension_direction: up}"]):
        (tmp_path / f"bad{i}.yaml").write_text(bad)
        with pytest.raises(ValueError):
            query_catalog.read_queries(spark, f"{tmp_path}/bad{i}.yaml")
    with pytest.raises(FileNotFoundError):
        query_catalog.read_queries(spark, f"{tmp_path}/none.yaml")


def test_own_queries_are_ranked(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "near", "target_va": "high_valence_high_arousal"}, {"query_id": "at", "target_cluster": 3}]))
    s = song(spark, SF)
    crossed = retrieval.crossed(s, query_catalog.read_queries(spark, f"{tmp_path}/q.json")).withColumn("v", retrieval.va_similarity())
    by = {}
    for r in crossed.select("query_id", "track_id", "v").collect():
        by.setdefault(r.track_id, {})[r.query_id] = r.v
    assert all(v["near"] == v["at"] for v in by.values()) and len(by) == s.count()
    out = runs.retrieve(interpreted(spark, SF), depth=3, queries=query_catalog.read_queries(spark, f"{tmp_path}/q.json"))
    assert {(r.query_id, r.system): r["count"] for r in out["rankings"].groupBy("query_id", "system").count().collect()} == {(q, s): 3 for q in ("near", "at") for s in retrieval.SYSTEMS}
