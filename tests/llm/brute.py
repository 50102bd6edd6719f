"""Plain versions of the operators, on rows in memory."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import regex
import tiktoken

from duoscope.llm import chunk_dedup, mixing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def shingles(text):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows, least=0.8):
    """{id: (class, links, shingles)} of rows (id, text) of distinct ids: all pairs that share a shingle are compared."""
    sets = {k: shingles(t) for k, t in rows}
    holders = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    links, parent = Counter(), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < k}:
            if len(s & sets[j]) / len(s | sets[j]) >= least - 1e-9:
                links[k] += 1
                links[j] += 1
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: (find(k), links[k], len(s)) for k, s in sets.items()}


def without_passages(rows):
    """{id: (text, spans)} of rows (id, text) of distinct ids: a run of chunks met before is compared with the text that has them first,
    byte by byte in both directions, and cut back to whole words."""
    met, out, texts, starts_of = {}, {}, {}, {}

    for k, t in sorted(rows):
        raw = texts[k] = (t or "").encode()
        starts, digests = chunk_dedup.digests(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        ends = starts_of[k] = [*starts.tolist(), len(raw)]
        refs = {}
        for i, d in enumerate(digests.tolist()):
            if d in met:
                refs[i] = met[d]
            else:
                met[d] = (k, i)
        gone = np.zeros(len(raw) + 1, bool)
        for i, (other, place) in refs.items():
            lo, hi = ends[i], ends[i + 1]
            there, at = texts[other], starts_of[other][place]
            blanks = [j for j in range(len(raw)) if raw[j] in b" \t\r\n"]
            if i - 1 not in refs and at > 0:
                first = lo
                while first > 0 and lo - first < min(at, chunk_dedup.AROUND) and raw[first - 1] == there[at - lo + first - 1]:
                    first -= 1
                while first < lo and raw[first] & 0xC0 == 0x80:
                    first += 1
                other_side = at - lo + first - 1
                if (first > 0 and first - 1 not in blanks) or (lo - first < chunk_dedup.AROUND and other_side >= 0 and there[other_side] not in b" \t\r\n"):
                    first = min((j for j in blanks if first <= j < min(first + chunk_dedup.LONG_WORD, hi)), default=first)
                while 0 < first < hi and first in blanks:
                    first += 1
                lo = first
            if i + 1 not in refs and (at := starts_of[other][place + 1]) < len(there):
                last = hi
                while last < len(raw) and last - hi < min(len(there) - at, chunk_dedup.AROUND) and raw[last] == there[at + last - hi]:
                    last += 1
                while hi < last < len(raw) and raw[last] & 0xC0 == 0x80:
                    last -= 1
                other_side = at + last - hi
                if (last < len(raw) and last not in blanks) or (last - hi < chunk_dedup.AROUND and other_side < len(there) and there[other_side] not in b" \t\r\n"):
                    last = max((j + 1 for j in blanks if max(lo, last - chunk_dedup.LONG_WORD) <= j < last), default=last)
                hi = last
            gone[lo:hi] = True
        edges = np.flatnonzero(np.diff(np.append(False, gone).astype(int))).tolist()
        spans = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if len(raw[a:b].split()) >= chunk_dedup.MIN_WORDS]
        new, at = b"", 0
        for a, b in spans:
            new, at = new + raw[at:a], b
        out[k] = ((new + raw[at:]).decode() if t is not None else None, ";".join(f"{a}-{b}" for a, b in spans))
    return out


def mixed(rows, rounds=200):
    """{id: (probability, kept)} of rows (id, text, source, lang)."""

    def topic(t):
        return next((name for name, mark in mixing.TOPICS if mark in (t or "")), "prose")

    cell = {r[0]: (r[2] or "none", r[3] or "none", topic(r[1])) for r in rows}
    tokens = Counter()
    for r in rows:
        tokens[cell[r[0]]] += len(re.findall(r"[^ \t\n\r]+", r[1] or ""))
    total, w = sum(tokens.values()), {c: float(n) for c, n in tokens.items()}
    goals = []
    for m in range(3):
        has = Counter()
        for c, n in tokens.items():
            has[c[m]] += n
        share = {k: n / total for k, n in has.items()}
        if m < 2:
            share = {k: s**0.8 if s >= mixing.SMALL else s * mixing.SMALL**-0.2 for k, s in share.items()}
        goals.append({k: s / sum(share.values()) * total for k, s in share.items()})
    for _ in range(rounds):
        for m, goal in enumerate(goals):
            present = Counter()
            for c, x in w.items():
                present[c[m]] += x
            w = {c: x if present[c[m]] <= 0 else x * goal[c[m]] / present[c[m]] for c, x in w.items()}
    ratio = {c: w[c] / n for c, n in tokens.items() if n}
    p = {c: ratio.get(c, max(ratio.values())) / max(ratio.values()) for c in tokens}
    draw = {r[0]: int(hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest()[:8], 16) / 2**32 for r in rows}
    return {r[0]: (p[cell[r[0]]], int(draw[r[0]] < p[cell[r[0]]])) for r in rows}
