"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel, with Nystroem landmarks.

The kernel of two words counts common subsequences of P characters, each weighted by DECAY to the length it spans in
either word, and is normalised; words have marks at both ends. So an insult with characters inserted, or apart with
gaps ("i d i o t" counts as one word), is still near its landmark. LANDMARKS words stand for the kernel space:
the Nystroem map of a word is its kernels with them, times the inverse root of their own kernel matrix.

Each language has its share of the landmarks. A word's weighted sum of kernels is read from one table by subsequence,
whose cost does not grow with the number of landmarks.

Training is multiple-instance: a labelled text is a bag of words, witnesses of a toxic text are its words of positive
decision and its highest one, and words of clean texts are examples of label 0. Documented bounds: a sample of labelled
texts (SAMPLE of either label, by a hash of their ids), and of the words of either label's texts the COMMON most
frequent and as many others by a hash, which stand for all others; training is done by numpy in one task, which gets
the distinct words of each sampled text, not the texts. A text's score is a logistic model of the decisions of its TOP
highest distinct words and of the numbers of its distinct words above LEVELS, so that many weak hits count as well as
one strong hit.

Scoring is one map over all texts; each Python worker scores a distinct word once and forgets beyond a bound. Null
and empty texts, and texts without letters or digits, have the score of a text of neutral words. If there is no label
of either kind to learn from, every score is 0.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import combinations, groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .shingles import _lower
from .textblocks import LETTER, NUMBER, SPACE, Block, blocks, classes, hashes, row_blocks, text_bytes

P = 3
DECAY = 0.6
LANDMARKS = 320
LEAST_SHARE = 24
NEUTRAL = 40
TOP = 3
LEVELS = (-0.4, 0.0, 0.4)
FLOOR, CEILING = -0.5, 1.5
SAMPLE = 2500
COMMON = 8000
BALANCES = (0.01, 0.03, 0.1)
TURNS = 4
LONGEST = 30
DENSE = 160
MOST_WORDS = 300_000
ROWS = 4096
CUTOFF = 0.7
_OPEN, _CLOSE = 1, 2  # marks of a word's ends


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points in lower case, starts, ends, each row's first word): white-space words trimmed to letters and digits.

    Three or more one-character words in a row are one word besides.
    """
    low = _lower()[block.cps]
    kind = classes()[block.cps]
    real = np.flatnonzero((kind == LETTER) | (kind == NUMBER))
    space = kind == SPACE
    start = ~space
    start[1:] &= space[:-1]
    first = block.offsets[:-1]
    first = first[first < len(space)]
    start[first] |= ~space[first]
    starts = np.flatnonzero(start)
    if not len(starts) or not len(real):
        return low, starts[:0], starts[:0], np.zeros(len(block.offsets), np.int64)
    gaps = np.append(np.flatnonzero(space), len(space))
    ends = np.minimum(gaps[np.searchsorted(gaps, starts)], np.append(starts[1:], len(space)))
    lo, hi = np.searchsorted(real, starts), np.searchsorted(real, ends)
    some = lo < hi
    starts, ends = real[lo[some]], real[hi[some] - 1] + 1
    return low, starts, ends, np.searchsorted(starts, block.offsets)


def spelled(block: Block, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[tuple[int, str]]:
    """(row, word) of each run of three or more one-character words."""
    single = np.flatnonzero(ends - starts == 1)
    if len(single) < 3:
        return []
    row = np.searchsorted(at, single, side="right") - 1
    new = np.ones(len(single), bool)
    new[1:] = (np.diff(single) > 1) | (np.diff(row) > 0)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(single)))
    return [(int(row[a]), "".join(chr(low[starts[i]]) for i in single[a : a + n])) for a, n in zip(first[sizes >= 3], sizes[sizes >= 3])]


def forms(word: str) -> list[str]:
    """A word as the kernel sees it: with and without the characters between its letters, long ones as overlapping parts."""
    plain = "".join(c for c in word if c.isalnum())
    out = []
    for w in dict.fromkeys([word, plain]):
        out += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    return [w for w in out if w]


def _codes(words_: list[str], alphabet: dict[str, int]) -> np.ndarray:
    """(place, word): small numbers of the characters, with end marks; 0 elsewhere and for characters not in the alphabet."""
    out = np.zeros((max(map(len, words_), default=0) + 2, len(words_)), np.uint16)
    for i, w in enumerate(words_):
        out[: len(w) + 2, i] = [_OPEN, *(alphabet.get(c, 0) for c in w), _CLOSE]
    return out


def _alphabet(words_: list[str]) -> dict[str, int]:
    return {c: i for i, c in enumerate(sorted(set("".join(words_))), 3)}


def _chains(s: np.ndarray, t: np.ndarray, paired: bool) -> np.ndarray:
    """Summed weights of P = 3 matches in a row, for all words of s with all of t, or for the pairs of equal index.

    Cell by cell of the alignment table, each cell a vector over the pairs: near[level][j] holds the chains that end
    in earlier rows before column j, row[level] those that end in this row, both decayed to the cell.
    """
    shape = (s.shape[1],) if paired else (s.shape[1], t.shape[1])
    decay = np.float32(DECAY)
    near = np.zeros((P - 1, len(t), *shape), np.float32)
    row, total, chain = np.zeros((P - 1, *shape), np.float32), np.zeros(shape, np.float32), np.zeros((P - 1, *shape), np.float32)
    last = np.zeros(shape, np.float32)
    for i in range(len(s)):
        row[:] = 0
        own = s[i] if paired else s[i][:, None]
        real = own != 0
        for j in range(len(t)):
            match = ((own == t[j]) & real).astype(np.float32)
            chain[0] = match
            for level in range(1, P - 1):
                np.multiply(match, near[level - 1, j], out=chain[level])
            np.multiply(match, near[P - 2, j], out=last)
            total += last
            at = near[:, j]
            at += row
            at *= decay
            row += chain
            row *= decay
    return total


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Unnormalised subsequence kernels of all left words with all right words, in blocks of left words of like length."""
    alphabet = _alphabet(right)
    t = _codes(right, alphabet)
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort([len(w) for w in left], kind="stable")
    size = max(16, (1 << 15) // max(1, len(right)))
    for lo in range(0, len(left), size):
        some = order[lo : lo + size]
        out[some] = _chains(_codes([left[i] for i in some], alphabet), t, False)
    return out


def own_kernel(words_: list[str]) -> np.ndarray:
    """Kernel of each word with itself."""
    out = np.zeros(len(words_), np.float32)
    alphabet = _alphabet(words_)
    order = np.argsort([len(w) for w in words_], kind="stable")
    for lo in range(0, len(words_), 4096):
        some = order[lo : lo + 4096]
        s = _codes([words_[i] for i in some], alphabet)
        out[some] = _chains(s, s, True)
    return out


@lru_cache(64)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """(3, number): places i < j < k of a word with its marks, and DECAY to the power k - i."""
    at = np.array(list(combinations(range(length), P)), np.int64).reshape(-1, P).T
    return at, (DECAY ** (at[2] - at[0])).astype(np.float32)


def _subsequences(words_: list[str], alphabet: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in words_, (word, triple) codes, weights of the triples), for words of one length at a time; a code of -1 is not in the alphabet."""
    base, order = len(alphabet) + 3, sorted(range(len(words_)), key=lambda i: len(words_[i]))
    for length, group in groupby(order, key=lambda i: len(words_[i])):
        group = np.array(list(group))
        at, weight = _triples(length + 2)
        size = max(1, (1 << 20) // len(weight)) if len(weight) else len(group)
        for lo in range(0, len(group), size):
            some = group[lo : lo + size]
            codes = _codes([words_[i] for i in some], alphabet).T.astype(np.int64)
            a, b, c = codes[:, at[0]], codes[:, at[1]], codes[:, at[2]]
            yield some, np.where((a > 0) & (b > 0) & (c > 0), (a * base + b) * base + c, -1), weight


def _explicit(words_: list[str], alphabet: dict[str, int], known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words_, dense weights of the known subsequences), some words at a time."""
    if not len(known):
        return
    for some, codes, weight in _subsequences(words_, alphabet):
        for lo in range(0, len(some), 256):
            part = codes[lo : lo + 256]
            place = np.searchsorted(known, part).clip(max=len(known) - 1)
            hit = known[place] == part
            cell = (np.arange(len(part))[:, None] * len(known) + place)[hit]
            dense = np.bincount(cell, np.broadcast_to(weight, part.shape)[hit], len(part) * len(known))
            yield some[lo : lo + 256], dense.reshape(len(part), len(known)).astype(np.float32)


@dataclass
class Model:
    landmarks: list[str]
    norms: np.ndarray
    weights: np.ndarray  # of the normalised kernels with the landmarks: Nystroem map and separator in one
    bias: float
    mix: np.ndarray  # of the evidence of a text, and a constant

    @cached_property
    def table(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """(alphabet, codes, weights): the landmarks' weighted sum by subsequence, so that their number costs a word nothing."""
        alphabet = _alphabet(self.landmarks)
        factor = self.weights / np.sqrt(self.norms)
        parts = [(codes.ravel(), (factor[some][:, None] * weight).ravel()) for some, codes, weight in _subsequences(self.landmarks, alphabet)]
        codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([w for _, w in parts]), len(codes)).astype(np.float32)
        if len(alphabet) + 3 > DENSE:
            return alphabet, codes, sums
        dense = np.zeros((len(alphabet) + 3) ** P + 1, np.float32)  # its last place is that of the code -1
        dense[codes] = sums
        return alphabet, codes[:0], dense

    def decisions(self, words_: list[str]) -> np.ndarray:
        if not words_:
            return np.zeros(0, np.float32)
        alphabet, known, value = self.table
        out = np.zeros(len(words_), np.float32)
        for some, codes, weight in _subsequences(words_, alphabet):
            if len(known):
                place = np.searchsorted(known, codes).clip(max=len(known) - 1)
                out[some] = np.where(known[place] == codes, value[place], 0) @ weight
            else:
                out[some] = value[codes] @ weight
        return out / np.sqrt(np.maximum(own_kernel(words_), 1e-12)) + np.float32(self.bias)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """Of texts, by their evidence."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(evidence, float) @ self.mix[:-1] + self.mix[-1], -40, 40)))


def similarity(words_: list[str], landmarks: list[str], norms: np.ndarray) -> np.ndarray:
    """Normalised kernels of all words with all landmarks, by a product of their explicit subsequences."""
    alphabet = _alphabet(landmarks)
    known = np.unique(np.concatenate([codes.ravel() for _, codes, _ in _subsequences(landmarks, alphabet)]))
    right = np.zeros((len(landmarks), len(known)), np.float32)
    for some, dense in _explicit(landmarks, alphabet, known):
        right[some] = dense
    out = np.zeros((len(words_), len(landmarks)), np.float32)
    for some, dense in _explicit(words_, alphabet, known[known >= 0]):
        out[some] = dense @ right[:, known >= 0].T
    return out / np.sqrt(np.maximum(own_kernel(words_), 1e-12)[:, None] * norms[None, :])


def shares(wanted: Counter, total: int) -> dict[str, int]:
    """Landmarks of each language: its share of the toxic texts, LEAST_SHARE at least."""
    return {k: max(LEAST_SHARE, total * n // sum(wanted.values())) for k, n in sorted(wanted.items())}


def _separator(z: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5) -> np.ndarray:
    """Linear support vector machine of squared hinge loss over some rows of z, by Newton steps; the last weight is the bias.

    ROWS of them are in double precision at once."""
    d = z.shape[1] + 1
    w, ridge = np.zeros(d), np.full(d, penalty)
    ridge[-1] = penalty / 100
    weight = weight / weight.sum()
    for _ in range(50):
        gradient, curvature = ridge * w, np.diag(ridge)
        for lo in range(0, len(rows), ROWS):
            part = rows[lo : lo + ROWS]
            x = np.empty((len(part), d))
            x[:, :-1], x[:, -1] = z[part], 1
            own, share = y[lo : lo + ROWS], weight[lo : lo + ROWS]
            margin = 1 - own * (x @ w)
            active = margin > 0
            xa, wa = x[active], share[active]
            gradient -= xa.T @ (wa * own[active] * margin[active])
            curvature += xa.T @ (xa * wa[:, None])
        step = np.linalg.solve(curvature, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is constant) of a logistic model with smoothed targets, by damped Newton steps."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, theta = np.where(y == 1, hi, lo), np.zeros(x.shape[1] + 1)
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.full(x.shape[1] - 1, 1e-2), 1e-9)

    def loss(t: np.ndarray) -> float:
        s = x @ t
        return float(np.sum(np.logaddexp(0, s) - target * s) + (ridge * t**2).sum() / 2)

    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.diag(ridge), x.T @ (q - target) + ridge * theta)
        scale = 1.0
        while scale > 1e-4 and loss(theta - scale * step) > loss(theta):
            scale /= 2
        theta = theta - scale * step
        if np.abs(step).max() < 1e-7:
            break
    return theta


def bags_of(texts: Iterable[str]) -> list[set[str]]:
    """Distinct words of each text."""
    column, out = pa.array(list(texts), pa.string()), []
    for b in blocks(column):
        low, starts, ends, at = words(b)
        text = low.tobytes().decode("utf-32-le", "replace")
        names = [text[x:y] for x, y in zip(starts.tolist(), ends.tolist())]
        own = [set(names[x:y]) for x, y in zip(at.tolist(), at[1:].tolist())]
        for row, w in spelled(b, low, starts, ends, at):
            own[row].add(w)
        out += [{v for w in bag for v in forms(w)} for bag in own]
    return out


def _landmarks(bags: list[set[str]], y: np.ndarray, langs: list[str], total: int) -> list[str]:
    """Words of high lift in the texts of each language that cover one another least, and the NEUTRAL most frequent clean words."""
    out: dict[str, None] = {}
    for lang, quota in shares(Counter(g for g, l, b in zip(langs, y, bags) if l and b), total).items():
        own = [(b, l) for b, l, g in zip(bags, y, langs) if g == lang]
        lift = lifts([b for b, l in own if l], [b for b, l in own if not l])
        ranked = sorted((w for w in lift if len(w) <= LONGEST), key=lambda w: (-lift[w], w))[: 10 * quota]
        norms = np.maximum(own_kernel(ranked), 1e-12)
        near = similarity(ranked, ranked, norms)
        gain, covered = np.array([lift[w] for w in ranked]), np.zeros(len(ranked))
        for _ in range(min(quota, len(ranked))):
            i = int(np.argmax(gain * (1 - covered)))
            out[ranked[i]] = None
            gain[i] = -np.inf
            covered = np.maximum(covered, near[i].clip(0, 0.999))
    clean = Counter(w for b, l in zip(bags, y) if not l for w in b)
    out |= dict.fromkeys(sorted((w for w in clean if len(w) <= LONGEST), key=lambda w: (-clean[w], w))[:NEUTRAL])
    return list(out)


def _some(counts: Counter) -> tuple[list[str], np.ndarray]:
    """Words and how often they stand: the COMMON most frequent, and for the others as many of them in an order by hash."""
    order = sorted(counts, key=lambda w: (-counts[w], w))
    rest = sorted(order[COMMON:], key=lambda w: (crc32(w.encode("utf-8", "replace")), w))
    part = rest[:COMMON]
    scale = sum(counts[w] for w in rest) / max(1, sum(counts[w] for w in part))
    return [*order[:COMMON], *part], np.array([*(counts[w] for w in order[:COMMON]), *(counts[w] * scale for w in part)], float)


def lifts(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """Of each word of toxic texts, how much more frequent it is there than in clean ones."""
    n1, n0 = len(toxic), len(clean)
    df1, df0 = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    return {w: float((np.log((a + 0.1) / (n1 + 0.2)) - np.log((df0[w] + 0.1) / (n0 + 0.2))) * np.sqrt(a)) for w, a in df1.items()}


def train(texts: list[str], labels: list[int], langs: list[str] | None = None, landmarks: int = LANDMARKS) -> Model | None:
    """A model from labelled texts, or None if one label is missing."""
    return train_bags(bags_of(texts), labels, langs, landmarks)


def train_bags(bags: list[set[str]], labels: list[int], langs: list[str] | None = None, landmarks: int = LANDMARKS) -> Model | None:
    """train() of the distinct words of each text."""
    y = np.array(labels)
    langs = [g or "" for g in langs or [""] * len(bags)]
    toxic, clean = [b for b, l in zip(bags, y) if l], [b for b, l in zip(bags, y) if not l]
    if not any(toxic) or not any(clean):
        return None
    n1, n0 = len(toxic), len(clean)
    df1, df0 = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    marks = _landmarks(bags, y, langs, landmarks)
    mark_norms = np.maximum(own_kernel(marks), 1e-12)
    own = similarity(marks, marks, mark_norms).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-3))  # the Nystroem map of kernels k is k @ root

    negative, times0 = _some(df0)
    positive, times1 = _some(df1)
    names = list(dict.fromkeys([*negative, *positive]))
    z = similarity(names, marks, mark_norms) @ root.astype(np.float32)
    at = {w: i for i, w in enumerate(names)}
    low, high = np.array([at[w] for w in negative]), np.array([at[w] for w in positive])
    bags1 = [np.array(sorted(at[w] for w in b if w in at), np.int64) for b in toxic]
    likely = np.zeros(len(names), bool)
    likely[high] = [df0[w] <= 0.02 * n0 and df1[w] * n0 > 3 * df0[w] * n1 for w in positive]
    every = sorted({w for b in bags for w in b})
    best, least = None, np.inf
    for balance in BALANCES:  # the one of least loss on the texts learnt from
        separator = _witnessed(z, low, times0, high, times1, bags1, likely, balance)
        if separator is None:
            continue
        model = Model(marks, mark_norms, (root @ separator[:-1]).astype(np.float32), float(separator[-1]), np.zeros(TOP + len(LEVELS) + 1))
        decision = dict(zip(every, model.decisions(every).tolist()))
        evidence = np.array([evidence_of([decision[w] for w in b]) for b in bags])
        used = list(range(evidence.shape[1]))
        while True:  # more evidence never lowers a score: a place of negative weight is left out
            fitted = _logistic(evidence[:, used], y)
            if (fitted[:-1] >= 0).all():
                break
            used.pop(int(np.argmin(fitted[:-1])))
        model.mix[used], model.mix[-1] = fitted[:-1], fitted[-1]
        p = model.probability(evidence).clip(1e-9, 1 - 1e-9)
        loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        if loss < least:
            best, least = model, loss
    return best


def _witnessed(z: np.ndarray, low: np.ndarray, times0: np.ndarray, high: np.ndarray, times1: np.ndarray, bags1: list[np.ndarray], likely: np.ndarray, balance: float) -> np.ndarray | None:
    """The separator of witnesses of toxic texts from words of clean ones, whose weights are 1 to `balance`.

    At first every word of a toxic text is a witness; then those of positive decision and the highest of each text.
    """
    chosen, weights = np.ones(len(z), bool), None
    for turn in range(TURNS):
        some = high[chosen[high]]
        if not len(some):
            break
        power, share = (1, 1) if turn == 0 else (0.5, balance)
        clean, toxic = times0**power, times1[chosen[high]] ** power
        toxic = toxic * (share * clean.sum() / toxic.sum())
        weights = _separator(z, np.append(some, low), np.append(np.ones(len(some)), -np.ones(len(low))), np.append(toxic, clean))
        decision = z @ weights[:-1] + weights[-1]
        if turn == 0:
            decision = decision - np.quantile(decision[low], 0.98)
        chosen = likely & (decision > 0)
        for b in bags1:
            if len(b) and likely[top := b[np.argmax(decision[b])]]:
                chosen[top] = True
    return weights if turn else None


def evidence_of(decisions: Iterable[float]) -> list[float]:
    """The TOP highest decisions between FLOOR and CEILING, filled up by FLOOR, and the logarithms of the numbers of decisions over LEVELS."""
    d = np.sort(np.fromiter(decisions, float))[::-1]
    return [*np.append(d[:TOP], [FLOOR] * TOP)[:TOP].clip(FLOOR, CEILING), *(np.log1p((d > level).sum()) for level in LEVELS)]


class Scores:
    """Decisions of words, each distinct word once for each worker, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def block(self, block: Block) -> np.ndarray:
        """The evidence of the distinct words of each row, as evidence_of gives it."""
        low, starts, ends, at = words(block)
        n = len(at) - 1
        out = np.zeros((n, TOP + len(LEVELS)))
        out[:, :TOP] = FLOOR
        if not len(starts):
            return out
        keys, first, back = np.unique(hashes(low, starts, ends), return_index=True, return_inverse=True)
        names = keys.tolist()
        if len(self.known) + len(names) > MOST_WORDS:
            self.known = {}
        new = [i for i, k in enumerate(names) if k not in self.known]
        if new:
            text = low.tobytes().decode("utf-32-le", "replace")
            found = [text[starts[j] : ends[j]] for j in first[new].tolist()]
            self.known.update(zip([names[i] for i in new], self.decisions(found).tolist()))
        decision = np.fromiter((self.known[k] for k in names), np.float32, len(names))
        high = np.flatnonzero(decision[back] > FLOOR)
        row = np.searchsorted(at, high, side="right") - 1
        pairs = np.unique(row * len(names) + back[high])
        row, value = pairs // len(names), decision[pairs % len(names)]
        runs = sorted(set(spelled(block, low, starts, ends, at)))
        if runs:
            row = np.append(row, [r for r, _ in runs])
            value = np.append(value, self.decisions([w for _, w in runs]))
        order = np.lexsort((-value, row))
        row, value = row[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < TOP
        out[row[kept], place[kept]] = value[kept].clip(FLOOR, CEILING)
        for i, level in enumerate(LEVELS, TOP):
            out[:, i] = np.log1p(np.bincount(row[value > level], minlength=n))
        return out

    def decisions(self, found: list[str]) -> np.ndarray:
        if all(len(w) <= LONGEST and w.isalnum() for w in found):
            return self.model.decisions(found)
        parts = [forms(w) or [w] for w in found]
        flat = self.model.decisions([v for p in parts for v in p])
        return np.maximum.reduceat(flat, np.cumsum([0, *(len(p) for p in parts[:-1])]))


_scores: dict[bytes, Scores] = {}


def scorer(name: bytes, model: Model) -> Scores:
    if name not in _scores:
        _scores.clear()
        _scores[name] = Scores(model)
    return _scores[name]


def held_out(key: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, lang: str = "lang") -> Model | None:
    """Trains on at most `sample` texts of either label, none of them held out; without a column `lang` all are of one language."""
    ids = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    ids = ids.filter(~held_out("id")).groupBy("id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("id"))
    some = None
    for value in (0, 1):
        part = ids.filter(F.col("label") == value).orderBy("order", "id").limit(sample)
        some = part if some is None else some.union(part)
    # 2 x sample rows of two numbers at most: a proven bound for the broadcast, and for the one task that trains
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), (F.col(lang) if lang in df.columns else F.lit("")).alias("lang")).join(F.broadcast(some.select("id", "label")), "id")
    ship(df.sparkSession)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [sorted(b) for b in bags_of(batch.column("text").fill_null("").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "lang")), pa.array(bags, pa.list_(pa.string()))], ["id", "label", "lang", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _scores.clear()  # what this worker holds for an earlier model
        names: dict[str, str] = {}  # one object for each word, however many texts have it
        found = []
        for batch in batches:
            words_, (ids_, labels_, langs_) = batch.column("words"), (batch.column(c).to_pylist() for c in ("id", "label", "lang"))
            found += [(i, y, g or "", {names.setdefault(w, w) for w in words_[at].as_py()}) for at, (i, y, g) in enumerate(zip(ids_, labels_, langs_))]
        found.sort(key=lambda r: r[0])
        model = train_bags([b for _, _, _, b in found], [y for _, y, _, _ in found], [g for _, _, g, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    once = rows.groupBy("id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label", "lang")).alias("r")).select("id", "r.*")  # a row an id
    bags = once.mapInArrow(words_of, "id long, label int, lang string, words array<string>")
    made = bags.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else None


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """df with each text's probability of being toxic. If the name is taken, ValueError."""
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the input already has a column {out}")
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    ship(df.sparkSession)
    name = b"|".join([model.weights.tobytes(), np.array([model.bias, *model.mix]).tobytes(), *(w.encode() for w in model.landmarks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(name, model)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(text))
            for lo, hi in row_blocks(offsets):
                value = own.model.probability(own.block(Block(raw, offsets, lo, hi)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], [*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
