"""Each stage of the pipeline on a small table, against what brute force keeps."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duoscope.llm import bpe
from duoscope.llm.storage import cut


def test_stages(spark, documents):
    sf = "/root/testdata/sf0.001"
    docs = documents.select(*corpus_pipeline.COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "encoding"]
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), name)
        sizes.append(docs.count())
        if name == "near_duplicates":
            ids = [r.doc_id for r in docs.collect()]
            assert 2 not in ids and 3 not in ids and ids.count(8) == 1 and {1, 4, 5, 6, 7, 10, None} <= set(ids)
        if name != "encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert sizes == sorted(sizes, reverse=True) and docs.columns == ["doc_id", "source", "lang", "token_ids", "n_tokens"]


def test_encoding_decodes_its_ids(spark, documents, monkeypatch):
    docs = documents.select(*corpus_pipeline.COLUMNS)
    assert corpus_pipeline.encode(spark, docs, "").filter("n_tokens is not null").count() == docs.count()
    encode = bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda *a, **b: encode(*a, **b).withColumn("met", F.lit(False)))
    with pytest.raises(Exception, match="decode to the text"):
        corpus_pipeline.encode(spark, docs, "").select("n_tokens").collect()
