"""The registered queries of this subpackage, opN_<name>, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_dedup, conversation_trie, fill_middle, fingerprints, licenses, media, mixing, ngram_join, speculative_bpe, token_counts, token_files, toxicity
from .storage import scratch

MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by two tokenizers and by words, rolled up over inserts, revisions, deletes and replays."""
    tokenizers = {name.split(".")[0]: public_tokenizers.path(name) for name in (MULTI_RANKS, "byte_bpe_50k.json")}
    return token_counts.maintained(documents(spark, sf_dir), scratch(spark, "rollup"), tokenizers)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return fingerprints.compare(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(MULTI_RANKS))


def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an Ogg file, read back and described."""
    return media.describe(media.to_media(documents(spark, sf_dir).select("doc_id", "text")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins, calibrated probability and decision of every document."""
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", *mixing.MARGINS, "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has, and the byte spans that went."""
    return chunk_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to Arrow files in doc_id order, and what the files hold."""
    return token_files.store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.drop("lang"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix by lines, put in another order and restored."""
    return fill_middle.digests(documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, which share their first turns in runs of five ids."""
    return conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conversation_trie.shared_heads())


def op13_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return speculative_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_token_counts": op2_token_counts,
        "op3_licenses": op3_licenses,
        "op4_fingerprints": op4_fingerprints,
        "op5_bpe": op5_bpe,
        "op6_ogg": op6_ogg,
        "op7_mixing": op7_mixing,
        "op8_chunk_dedup": op8_chunk_dedup,
        "op9_token_files": op9_token_files,
        "op10_toxicity": op10_toxicity,
        "op11_fill_middle": op11_fill_middle,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_speculative_bpe": op13_speculative_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licenses.oracle_sql(), "op7_mixing": mixing.oracle_sql(), "op11_fill_middle": fill_middle.oracle_sql(), "op12_conversation_trie": conversation_trie.oracle_sql()}
