"""Empty tables, clashing names, repeated rows, ties and very long texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duoscope.llm import chunk_dedup, fingerprints, licenses, media, mixing, ngram_join, token_counts, token_files, toxicity
from duoscope.llm.components import components
from duoscope.llm.storage import scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_empty_tables(spark, documents):
    none = documents.drop("key", "id", "component").limit(0)
    assert licenses.scan(none).count() == chunk_dedup.dedup(none).count() == ngram_join.near_duplicates(none).count() == fingerprints.compare(none).count() == 0
    assert token_counts.Rollup(spark, scratch(spark, "none")).totals().count() == 0 and not token_counts.Rollup(spark, scratch(spark, "none")).batches()
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(none, labels) is None and toxicity.fit(documents, labels.limit(0)) is None
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0, name


def test_extra_columns_of_clashing_names(spark, documents):
    more = documents.withColumns({c: F.lit("x") for c in ("media", "start", "n_tokens", "path", "part", "bucket", "rep", "copies", "digest", "place", "n", "side", "which", "word", "term", "label", "score", "words")})
    assert token_files.store(more, TOKENIZER).count() == more.count() and ngram_join.near_duplicates(more).count() == more.count()
    assert fingerprints.compare(more).count() == 11 and chunk_dedup.dedup(more).count() == more.count()
    labels = spark.createDataFrame([(i, i % 2, "x") for i in (1, 2, 3, 7, 9)], "doc_id long, toxic int, words string")
    toxicity.fit(more, labels)
    for stage in (s for _, s in corpus_pipeline.STAGES[:4]):
        assert stage(spark, more.drop("bucket"), "/root/testdata/sf0.001").columns == corpus_pipeline.COLUMNS
    for clash in (lambda: mixing.mix(more), lambda: media.to_media(more), lambda: toxicity.score(more, None)):
        with pytest.raises(ValueError):
            clash()


def test_repeated_rows_are_alike(spark):
    rows = [(1, "Released under the MIT License.", "en", "a")] * 3 + [(2, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert licenses.scan(df).select("licenses").distinct().count() == 2 and licenses.scan(df).count() == 5
    assert media.describe(media.to_media(df)).distinct().count() == 2
    mixed = mixing.mix(df).collect()
    assert len(mixed) == 5 and len({(r.doc_id, r.kept, r.probability) for r in mixed}) == 2
    model = toxicity.train(["idiot moron"] * 4 + ["calm text here"] * 4, [1] * 4 + [0] * 4)
    assert len({(r.doc_id, r.score) for r in toxicity.score(df, model).collect()}) == 2
    got = ngram_join.near_duplicates(df).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(1, 1, 2), (2, 2, 0)}


def test_ties(spark):
    """Cells of one ratio, and texts of one score, are treated alike."""
    df = spark.createDataFrame([(i, "w w", "en", f"s{i % 2}") for i in range(40)], "doc_id long, text string, lang string, source string")
    assert {r.probability for r in mixing.mix(df).select(F.round("probability", 9).alias("probability")).collect()} == {1.0}
    model = toxicity.train(["idiot moron"] * 4 + ["calm text here"] * 4, [1] * 4 + [0] * 4)
    assert toxicity.score(df, model).select("score").distinct().count() == 1


def test_very_long_texts(spark):
    long = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(300_000))
    df = spark.createDataFrame([(1, long, "en", "a"), (2, long[:1_000_000] + " other end", "en", "a"), (3, "x" * 1_500_000, "en", "a")], "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in chunk_dedup.dedup(df).collect()}
    assert got[1].removed == 0 and got[2].removed > 990_000 and got[3].n_chunks >= 1_500_000 // chunk_dedup.MAX_CHUNK
    assert {r.doc_id: r.n_tokens for r in mixing.mix(df).collect()} == {1: 300_000, 2: len((long[:1_000_000] + " other end").split()), 3: 1}
    assert {r.status for r in media.describe(media.to_media(df)).collect()} == {"ok"}
    assert licenses.scan(df).filter("licenses <> ''").count() == 0


def test_components_leave_out_nulls_and_loops(spark):
    edges = spark.createDataFrame([(1, 2), (None, 3), (4, None), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1)}
    assert components(edges.limit(0)).count() == 0
