"""The corpus pipeline: five stages from raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents.

Defined results: rows of null id never have a near duplicate or a repeated passage and are kept by the stages before
mixing, which treats them by their cell; a null text is an empty one in the last stage; equal rows with one id are
copies of one another, of which near_duplicates keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm import bpe, chunk_dedup, mixing, ngram_join, toxicity
from duoscope.llm.storage import cut

RANKS = "byte_bpe_multi_50k.tiktoken"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cutoff, by a model learnt from the labels that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model, out="toxicity").filter(F.col("toxicity") < toxicity.CUTOFF).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate class."""
    classes = ngram_join.near_duplicates(docs).filter("doc_id is null or doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(classes.filter("doc_id is not null"), "doc_id", "left_semi").select(*COLUMNS)
    return kept.dropDuplicates(["doc_id"]).union(docs.filter("doc_id is null").select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has."""
    cleaned = chunk_dedup.dedup(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents that meets the target weights of sources and languages."""
    return mixing.mix(docs.select(*COLUMNS)).filter("kept = 1").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, token_ids, n_tokens of each document; the ids are decoded, and if a text isn't met the stage fails."""
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(RANKS), met="met")
    failed = F.raise_error(F.concat(F.lit("ids don't decode to the text of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.when(F.col("met"), F.size("token_ids").cast("long")).otherwise(failed.cast("long"))
    return coded.select("doc_id", "source", "lang", "token_ids", size.alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can express neither the learnt scores nor the encoder; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
