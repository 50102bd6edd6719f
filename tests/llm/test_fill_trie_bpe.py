"""Fill-in-the-middle rows, the conversation trie and speculative BPE against plain versions."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duoscope.llm import conversation_trie, fill_middle, queries, speculative_bpe
from duoscope.llm.textblocks import blocks

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def filled(key, text, units=r"[^\n]*\n|[^\n]+", seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    """(n, form, prefix chars, middle chars, output) of one row."""
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = re.findall(units, text)
    assert "".join(parts) == text
    a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return len(parts), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(parts), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return len(parts), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


ODD = ["", None, "\n", "\n\n\n", "a", "a\n", "é\n漢字\n🎈", "no\r\nblank\n \n", "x<P>y\nz", "<S", "<\nM>", "one <M> two", "P>\n<P", "a b  c\n\td", "x" * 3_000_000 + "\nend", "<P\n><S\n>"]


def test_fill_middle_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_fill_middle(spark, SF).collect()}
    for r in queries.documents(spark, SF).collect():
        n, form, p, m, out = filled(r.doc_id, r.text)
        assert got[r.doc_id] == (n, form, p, m, sha(out), sha(r.text or ""))
    assert {x[1] for x in got.values()} >= {"psm", "spm"}


@pytest.mark.parametrize("unit, units", [("line", r"[^\n]*\n|[^\n]+"), ("word", r"(?:^[ \t\r\n]*)?[^ \t\r\n]+[ \t\r\n]*|^[ \t\r\n]+"), ("character", r"(?s).")])
@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (100, 100)])
def test_fill_middle_of_odd_texts(spark, unit, units, rate, spm):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id\nat all"), (3, ODD[3]), (3, ODD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("draws", F.lit(1)).repartition(3)
    made = fill_middle.transform(df, seed=11, unit=unit, rate=rate, spm=spm).withColumn("back", fill_middle.restore())
    got = made.collect()
    assert len(got) == len(rows) and made.columns == ["doc_id", "text", "draws", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == filled(r.doc_id, r.text, units, 11, rate, spm)
        assert r.back == (r.text or "")


def test_fill_middle_refuses(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (lambda: fill_middle.transform(df, unit="page"), lambda: fill_middle.transform(df.withColumn("Form", F.lit(1))), lambda: fill_middle.transform(df, sentinels=("<P>", "><", "<M>")), lambda: fill_middle.transform(df, sentinels=("<P>", "<P>x", "<M>")), lambda: fill_middle.transform(df, sentinels=("aba", "<S>", "<M>"))):
        with pytest.raises(ValueError):
            bad()
    assert fill_middle.digests(df.limit(0)).collect() == []


def trie(rows, every=5):
    """Nodes of rows (conv, turn, role, text), by a dictionary of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    with_prefix, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        base, h = int(c / every) * every, zlib.crc32(str(c).encode()) % 9
        whole = own.get(base, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            with_prefix[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    kids = defaultdict(list)
    for p in with_prefix:
        if p:
            kids[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(with_prefix, key=len, reverse=True):
        n = len(with_prefix[p])
        leaves = sum(below[k][0] for k in kids[p]) if kids[p] else 1
        saved = (n - 1) * (len(p[-1][1].encode()) if p else 0) + sum(below[k][1] for k in kids[p])
        below[p] = leaves, saved
        out.append((min(with_prefix[p]), len(p), min(with_prefix[p[:-1]]) if p else None, n, len(kids[p]), leaves, saved, sha(",".join(map(str, sorted(ends.get(p, [])))))))
    return sorted(out, key=repr)


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_conversation_trie(spark, SF).collect()), key=repr) == trie(rows)


def test_trie_of_odd_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b", ""])) for c in range(40) for t in range(rng.randrange(1, 14))]
    rows += [(-c, t, "user", "a") for c in (1, 5, 7, 12) for t in range(4)]  # negative ids
    rows += [(1000, t, "user", f"line {t % 7}") for t in range(900)] + [(1001, t, "user", f"line {t % 7}") for t in range(300)]  # long ones that share much
    rows += [(2000, None, "user", "null first"), (2000, 0, "user", "zero"), (2000, 0, "user", "tie"), (2000, 0, "user", "tie")]
    rows += [(3001, 0, "u", "x")] + [(None, 0, "user", "no id")] * 3 + [(4000 + 5 * i, 0, "same", "start") for i in range(5000)]  # one end list over several blocks
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "part", "slice", "place", "a", "b", "depth")})
    got = conversation_trie.prefix_trie(df.repartition(6), conversation_trie.shared_heads())
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie(rows)


def test_trie_without_heads_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "v", "bé"), (2, 0, "u", "a"), (3, 0, "ua", "")], "id long, n long, who string, said string")
    got = {tuple(r)[:7] for r in conversation_trie.prefix_trie(df, conv="id", turn="n", role="who", text="said").collect()}
    assert got == {(1, 0, None, 3, 2, 2, 1), (1, 1, 1, 2, 1, 1, 1), (1, 2, 1, 1, 0, 1, 0), (3, 1, 1, 1, 0, 1, 0)}
    assert conversation_trie.prefix_trie(df.limit(0), conv="id", turn="n", role="who", text="said").collect() == []


def test_merges_of_many_partial_tries(spark):
    """More parts than one round takes together."""
    df = spark.range(10_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 2000).cast("int").alias("part"), F.lit(1).cast("long").alias("n"))
    got = conversation_trie.merged(df, ["a"], 2000, n=F.sum("n"))
    assert {r.a: r.n for r in got.collect()} == {i: len(range(i, 10_000, 7)) for i in range(7)}


def test_bpe_query(spark):
    t, got = Tokenizer.from_file(BPE), {r.doc_id: tuple(r)[1:] for r in queries.op13_speculative_bpe(spark, SF).collect()}
    for r in queries.documents(spark, SF).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t.decode(ids, skip_special_tokens=False)))


def test_bpe_codings(spark):
    t = Tokenizer.from_file(BPE)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abeéü  '\n\tslt019漢🎈") for _ in range(rng.randrange(80))) for _ in range(2000)]
    texts += ["a" * 5000, "ab" * 40_000, "", None, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", " it's we'll 　 x "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    coded = speculative_bpe.encode(df, BPE)
    back = speculative_bpe.decode(coded, BPE)
    for r in back.collect():
        assert r.token_ids == t.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    parts = spark.createDataFrame([([447],), ([447, 247, 50256],), (None,), ([],)], "token_ids array<int>")
    assert [r.decoded for r in speculative_bpe.decode(parts, BPE).collect()] == [t.decode([447]), t.decode([447, 247, 50256], skip_special_tokens=False), "", ""]
    for bad in (lambda: speculative_bpe.encode(coded, BPE), lambda: speculative_bpe.decode(back, BPE)):
        with pytest.raises(ValueError):
            bad()
    assert speculative_bpe.round_trip(df.limit(0), BPE, "id").collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_bpe_of_made_up_merges(tmp_path, seed):
    """Random merges over three letters, where most greedy guesses are wrong and many tokens are never the merge of their own bytes."""
    rng = random.Random(seed)
    letters = {b: c for c, b in speculative_bpe.byte_letters().items()}
    vocab, merges = {letters[b]: b for b in range(256)}, []
    made = ["a", "b", "c"]
    while len(merges) < 60:
        x, y = rng.choice(made), rng.choice(made)
        if x + y not in vocab and len(x + y) < 12:
            vocab[x + y] = len(vocab)
            merges.append(f"{x} {y}")
            made.append(x + y)
    spec = json.load(open(BPE))
    spec["model"] |= {"vocab": vocab, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path / "made.json"
    path.write_text(json.dumps(spec))
    t, own = Tokenizer.from_file(str(path)), speculative_bpe.Model(str(path))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(3000)]
    ids, offsets = own.encode_block(next(blocks(pa.array(texts, pa.string()))))
    assert [x.tolist() for x in np.split(ids, offsets[1:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    for token, i in own.ids.items():
        assert (token in own.known) == (own.merge(token) == [i])
    a, b = (np.array([rng.choice(list(own.known.values())) for _ in range(3000)]) for _ in range(2))
    assert own.fit(a, b).tolist() == [own.merge(own.bytes_of[x] + own.bytes_of[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
