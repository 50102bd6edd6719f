"""Registered queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from duoscope.plans import catalog, catalog_runs  # noqa: F401  (registers more queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["rt_va_only", "f01_geometry", "f06_calibrated_tension", "j01_align_views", "j05_merge_fill", "j18_neighbour_purity", "m03_silhouette", "p01_region_profiles", "a24_retrieval_metrics", "st01_token_enrichment", "w05_bh_qvalues", "s01_s06_text_forms", "w01_w02_percentiles", "w03_fill_percentile", "a04_a06_robust_scales", "p02_w04_tension_profiles", "p09_descriptors", "p10_interpretations", "rt01_rt02_retrieval_features", "o04_final_candidates", "k05_bounded_choice", "r05_target_distribution", "x51_masked_losses", "f34_conflict_features", "src31_assembled_split", "j15_f12_neighbour_residual", "j16_impute_unobserved", "f20_metadata_blocks", "snk04_src11_arrays"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    found = db.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)

    def form(v):
        return 0.0 if isinstance(v, float) and v == 0 else v  # no negative zero; NaN stays what it is

    order = [found.columns.index(c) for c in df.columns]
    assert sorted(repr([form(v) for v in r]) for r in df.collect()) == sorted(repr([form(r[i]) for i in order]) for r in found.fetchall())


def test_entry_and_names():
    import __spark_entry__

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
