"""Repeated passages by length, against the texts they were put into."""

import random

import pytest

from duoscope.llm import chunk_dedup


def words(rng, n, lo, hi):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü漢") for _ in range(rng.randint(lo, hi))) for _ in range(n))


def beside(k, rng, n, lo, hi):
    """Words that no other text has."""
    return " ".join(f"{w}{k}" for w in words(rng, n, lo + 4, hi + 4).split())


@pytest.mark.parametrize("lo, hi", [(2, 8), (1, 4)])
def test_passages_of_the_stated_length_go_whole(spark, lo, hi):
    """Each passage stands in three texts of other words: it stays in the first and goes from the others, whole and alone."""
    rng, rows, want = random.Random(lo), [], {}
    for n in (25, 26, 30, 40, 51, 80):
        for _ in range(40):
            passage = words(rng, n, lo, hi)
            for copy in range(3):
                k = len(rows)
                before, after = beside(k, rng, 30, lo, hi) + " ", " " + beside(k, rng, 30, lo, hi)
                rows.append((k, before + passage + after))
                want[k] = (n, copy, passage, before, after)
    got = {r.doc_id: r for r in chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    met = {}
    for k, (n, copy, passage, before, after) in want.items():
        if copy == 0:
            assert got[k].text == rows[k][1]
            continue
        met.setdefault(n, []).append(got[k].removed > 0)
        if got[k].removed:  # a blank beside the passage may go with it, but no word around it, and all of it
            assert passage not in got[k].text and got[k].text.split() == (before + after).split()
    assert all(sum(v) / len(v) >= 0.95 for v in met.values()) and all(met[80]) and all(met[51])


def test_shorter_passages_stay(spark):
    rng = random.Random(9)
    passage = words(rng, 24, 2, 8)
    rows = [(i, beside(i, rng, 30, 2, 8) + " " + passage + " " + beside(i, rng, 30, 2, 8)) for i in range(20)]
    assert all(r.removed == 0 and r.text == rows[r.doc_id][1] for r in chunk_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_stretches_that_repeat_within_a_text(spark):
    rng = random.Random(2)
    passage, ends = words(rng, 40, 2, 8), [beside(k, rng, 20, 2, 8) for k in range(4)]
    text = f"{ends[0]} {passage} {ends[1]} {passage} {ends[2]} {passage} {passage}"
    got = chunk_dedup.dedup(spark.createDataFrame([(1, text), (2, passage + " " + ends[3]), (2, passage + " " + ends[3]), (3, None), (4, passage)], "doc_id long, text string")).collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text.split() == f"{ends[0]} {passage} {ends[1]} {ends[2]}".split() and by_id[2].text.split() == ends[3].split() and by_id[3].text is None and by_id[4].text == ""


def test_ends_of_stretches_are_between_characters_and_words():
    raw = "xé stays here and goes".encode()
    there = "yé stays here and gone".encode()
    lo, hi = raw.index(b"here"), raw.index(b"and") + 3
    at = there.index(b"here")
    got = chunk_dedup.extended(raw, lo, hi, there[:at], there[at + hi - lo :])
    assert raw[got[0] : got[1]].decode() == "stays here and "
    part = chunk_dedup.extended(b"xx aj here", 6, 10, b"zraj ", None)  # a word here, but only the end of one there
    assert part == (6, 10)
    assert chunk_dedup.extended(raw, lo, hi, None, b"") == (lo, hi)
    one, other = "ab漢here".encode(), "cd弢here".encode()  # no blank: between characters, whose last bytes may be equal
    assert chunk_dedup.extended(one, 5, len(one), other[:5], None) == (5, len(one))
