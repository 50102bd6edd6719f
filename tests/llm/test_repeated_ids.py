"""Ids that stand for several texts, and hubs."""

from pyspark.sql import functions as F

from duoscope.llm import ngram_join
from duoscope.llm.components import components
from duoscope.llm.storage import cut


def test_texts_of_one_id_have_their_own_links(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"v{i}" for i in range(200))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (4, "alone on its own here now"), (1, None), (None, a)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = sorted((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in got if r.doc_id is not None)
    assert told == [(1, 1, 0, 0), (1, 1, 1, 196), (1, 1, 2, 196), (2, 1, 1, 197), (3, 1, 2, 197), (3, 1, 2, 197), (4, 4, 0, 2)]
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, None, 0, 0)]


def test_a_class_of_renamed_texts_has_the_least_id(spark):
    a, b = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    rows = [(9, a), (9, b), (7, a + " x"), (8, a + " y"), (8, b + " z")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, 7, 2), (8, 7, 2), (8, 8, 1), (9, 7, 2), (9, 8, 1)]


def test_joins_at_a_hub_are_split(spark):
    """Half of the edges meet in one node: its rows are dealt to several tasks."""
    n = 60_000
    edges = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") - 1).alias("a"), (F.col("id") + 1).alias("b"))
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        stored = cut(edges.repartition(4), "hub")
        least = cut(stored.groupBy("a").agg(F.min("b").alias("m")), "hub-least")
        joined = stored.join(least, "a")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert components(edges).select("component").distinct().count() == 1
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
