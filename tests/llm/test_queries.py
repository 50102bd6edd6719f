"""Each registered query over whole tables, against plain versions or SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from duoscope.llm import media, queries, toxicity
from duoscope.llm.storage import cut
from duoscope.llm.textblocks import blocks

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text, r.source, r.lang) for r in queries.documents(spark, SF).collect()]


@pytest.fixture(scope="module")
def texts(rows):
    return {r[0]: r[1] or "" for r in rows}


def collected(spark, name):
    return {r.doc_id: r for r in queries.queries()[name](spark, SF).collect()}


def test_op1(spark, rows):
    got = collected(spark, "op1_ngram_join")
    assert {k: (r.class_id, r.n_links, r.n_shingles) for k, r in got.items()} == brute.classes([r[:2] for r in rows])


def test_op2(spark, rows):
    e, t = brute.encoding(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in queries.op2_token_counts(spark, SF).collect()}
    want = {}
    for _, text, source, lang in rows:
        for version, n in (("byte_bpe_multi_50k", len(e.encode_ordinary(text or ""))), ("byte_bpe_50k", len(t.encode(text or "", add_special_tokens=False).ids)), ("words-1", len((text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")) - (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ").count(""))):
            d, s = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (d + 1, s + n)
    assert got == want


@pytest.mark.parametrize("name", ["op3_licenses", "op7_mixing"])
def test_queries_with_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, found = queries.queries()[name](spark, SF), db.sql(queries.oracle_sql()[name])
    order = [found.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_op4(spark, texts):
    got, down = collected(spark, "op4_fingerprints"), sorted(texts, reverse=True)
    assert set(got) == set(texts)
    for one, two in zip(down, down[1:] + down[:1]):
        t = texts[one]
        changed = t[: len(t) - len(t) // 3] + texts[two][: len(t) // 3]
        assert (got[one].n_chars, got[one].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest()) and 0 <= got[one].near_edited <= 1
        if texts[two] == t:
            assert got[one].fingerprint == got[two].fingerprint and got[one].near_next == 1


def test_op5(spark, texts):
    e, got = brute.encoding(), collected(spark, "op5_bpe")
    for k, t in texts.items():
        ids = e.encode_ordinary(t)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op6(spark, texts):
    got = collected(spark, "op6_ogg")
    for k, t in texts.items():
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        stored = media.write_ogg(payload, len(raw))
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (got[k].media_bytes, got[k].media_sha256, got[k].status) == (len(stored), hashlib.sha256(stored).hexdigest(), "ok")


def test_op8(spark, rows):
    got = collected(spark, "op8_chunk_dedup")
    assert {k: (r.text, r.spans) for k, r in got.items()} == brute.without_passages([r[:2] for r in rows])


def test_op9(spark, texts):
    t, got, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collected(spark, "op9_token_files"), 0
    for k in sorted(texts):
        ids = t.encode(texts[k], add_special_tokens=False).ids + [2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op10(spark, texts):
    got = collected(spark, "op10_toxicity")
    model = toxicity.fit(queries.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"))
    own = toxicity.Scores(model)
    keys = sorted(texts)
    want = np.concatenate([model.probability(own.block(b)) for b in blocks(pa.array([texts[k] for k in keys], pa.string()))])
    for k, p in zip(keys, want):
        assert got[k].score == pytest.approx(p, abs=1e-9) and got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and got[k].predicted == int(got[k].score >= 0.7)


def test_pipeline_stage_by_stage(spark, documents):
    """Each stage on what its predecessor kept, against plain versions, and run() over the whole tables."""
    e, docs = brute.encoding(), queries.documents(spark, SF).union(documents.filter("doc_id is not null").selectExpr("doc_id - 100 as doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"]))
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
        by_id = {r[0]: r[1] for r in before}
        assert len(by_id) == len(before)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        docs = cut(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            own, keys = toxicity.Scores(model), sorted(by_id)
            p = np.concatenate([model.probability(own.block(b)) for b in blocks(pa.array([by_id[k] or "" for k in keys], pa.string()))])
            assert set(after) == {k for k, x in zip(keys, p) if x < toxicity.CUTOFF}
        elif name == "near_duplicates":
            assert set(after) == {k for k, (c, _, _) in brute.classes(list(by_id.items())).items() if c == k}
        elif name == "repeated_passages":
            assert {k: r.text for k, r in after.items()} == {k: t for k, (t, _) in brute.without_passages(list(by_id.items())).items()}
        elif name == "mixing":
            assert set(after) == {k for k, (_, kept) in brute.mixed(before).items() if kept}
        else:
            assert {k: list(r.token_ids) for k, r in after.items()} == {k: e.encode_ordinary(t or "") for k, t in by_id.items()} and all(r.n_tokens == len(r.token_ids) for r in after.values())
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == ["doc_id", "source", "lang", "token_ids", "n_tokens"] and 0 < whole.count() <= queries.documents(spark, SF).count()
