"""Toxic documents by a subsequence-kernel support vector machine with Nystrom landmarks, trained on labelled sentences.

A sentence ends at a full stop, exclamation or question mark before white space, or at a line's end; longer ones
count as several of up to TOKENS tokens.  A token keeps its letters only (compatibility forms and accents folded,
look-alike digits read as letters, signs between letters skipped, a letter in a row read three times at most; runs of three or more one-letter tokens are read as
one token), with an edge mark on either side.  Latin letters have the marks 1 to 26, letters of other scripts the
rest, an ideograph two of them; Hangul is read by its parts.  Scripts without spaces are read in overlapping tokens of
two ideographs or four other letters.

The kernel of two sentences counts the subsequences of four marks they share, each weighed by DECAY for every place of
its spread, with up to two places skipped inside, none across an edge; it is divided by a norm that depends on the tokens'
lengths (and a constant), so it stays a positive kernel; a token of one letter, or that only repeats the one before, does not count.
Skipped places are what lets ``id-iot``, ``idxiot`` and ``idiiot`` share
most subsequences with ``idiot``.

Labels belong to documents: a toxic document has at least one toxic sentence, the others have none (multiple-instance
training).  At first the sentence that speaks most for a toxic document is the one whose subsequences are most
frequent in toxic documents against the others; the machine is trained with these sentences against sentences of the
other documents (some drawn, and those that come out highest), and then itself picks the sentence for the next of ROUNDS
rounds.  Landmarks are training sentences, or three tokens of one around the token that speaks most; the machine is trained on the Nystrom map of the kernel.  Since a value is a
sum over landmarks of kernels, and a kernel a sum over subsequences, the landmarks' weights are added up beforehand
into one weight for each subsequence; rating a sentence is a sum over its own subsequences, the same number.

A document has the value of its worst sentence, on a scale whose 0.3 divides best the training documents as rated
by machines that have not seen them (FOLDS of them).

Defined results: null, empty and letterless texts score 0; with no toxic or no other training row everything
scores 0; of sentences with equal values the first is picked; very long texts are read whole, one at a time;
an empty table gives no rows; repeated rows stay and score alike; extra columns stay, whatever their names ("toxicity" is replaced).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_sample, chunks, code_points, lean, mix64, numbered, quoted, sampled_texts, text_chunks, trim

#: Training texts of each label and their bytes (about); landmarks at most; training sentences of the negative class.
SAMPLE_PER_LABEL, SAMPLE_BYTES, LANDMARKS, NEGATIVES = 3000, 8 << 20, 800, 4000
#: Tokens of a sentence at most; rounds of training; parts of the training documents that are rated unseen.
TOKENS, ROUNDS, FOLDS = 8, 2, 2
#: Weight of each place of a subsequence's spread; marks in a subsequence; places it may skip in all.
DECAY, ORDER, SKIPS = 0.7, 4, 2
THRESHOLD = 0.3
#: Cost of a training sentence on the wrong side.
COST = 10.0
#: What a document taken for toxic costs when the threshold is set, against 1 for a toxic one that is missed.
FALSE = 5.0
_EDGE, _WIDE, _SPACE, _SKIP, _RADIX = 0, 253, 254, 255, 27
#: Marks of letters that are not a to z; slots of the subsequence weights.
_OTHERS, SLOTS = _WIDE - _RADIX, 1 << 21
#: What a mark counts in a subsequence's slot: Latin ones itself (slots below 27**4 are exact), others a scattered number.
_VALUES = np.array([m if m < _RADIX else (m * 0x9E3779B1 >> 7) % SLOTS for m in range(256)], np.int32)
#: Private code points that stand for the two marks of an ideograph.
_HALF = 0xF0000
_HAN = "\u3005\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
_ALPHABETIC = "\u0e01-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u3041-\u3096\u30a1-\u30fa\u30fc\u31f0-\u31ff\uff66-\uff9d"
_UNSPACED = re.compile(f"[{_HAN}]+|[{_ALPHABETIC}]+")
#: Digits and signs read as letters (fixed values).
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Offsets of the second, third and fourth mark after the first.
STEPS = [(a, a + b, a + b + c) for a in range(1, 2 + SKIPS) for b in range(1, 2 + SKIPS) for c in range(1, 2 + SKIPS) if a + b + c <= ORDER - 1 + SKIPS]


def folded(c: str) -> str:
    """The letters that c is read as."""
    parts = unicodedata.normalize("NFKD", c)
    parts = LOOKALIKES.get(parts, parts).lower()
    return "".join(x for x in unicodedata.normalize("NFKD", parts) if unicodedata.category(x)[0] == "L" or unicodedata.category(x) == "Mc")


@lru_cache(maxsize=1)
def mark_table() -> np.ndarray:
    """Per code point: 1 to 26 for Latin letters, up to _WIDE for others, _WIDE for what unfolded() must read first,
    _SPACE for white space, else _SKIP."""
    table = np.full(0x110000, _SKIP, np.uint8)
    wide = re.compile(f"[{_HAN}{_ALPHABETIC}]")
    for cp in range(0x32400):
        c = chr(cp)
        if c.isspace():
            table[cp] = _SPACE
        elif "\u4e00" <= c <= "\u9fff" or wide.match(c):
            table[cp] = _WIDE
        elif base := folded(c):
            if len(base) > 1 or wide.match(base):
                table[cp] = _WIDE
            else:
                table[cp] = ord(base) - 96 if "a" <= base <= "z" else _RADIX + ord(base) % _OTHERS
    table[_HALF : _HALF + _OTHERS] = np.arange(_RADIX, _WIDE)
    return table


class _Letters(dict):
    """For str.translate: code points that take several marks, as code points of one mark each."""

    def __missing__(self, cp: int) -> str:
        out = chr(cp)
        if mark_table()[cp] == _WIDE:
            out = ""
            for c in map(ord, folded(chr(cp))):
                if re.match(f"[{_HAN}]", chr(c)):
                    out += chr(_HALF + c // _OTHERS % _OTHERS) + chr(_HALF + c % _OTHERS)
                else:
                    out += chr(c) if mark_table()[c] < _WIDE else chr(_HALF + c % _OTHERS)
        self[cp] = out
        return out


_LETTERS = _Letters()


def unfolded(text: str) -> str:
    """text with overlapping tokens in place of unspaced runs, each code point of one mark."""

    def grams(m: re.Match) -> str:
        run, n = "".join(c for c in m[0] if mark_table()[ord(c)] != _SKIP), 2 if re.match(f"[{_HAN}]", m[0]) else 4
        return " " + " ".join(run[i : i + n] for i in range(max(1, len(run) - n + 1))) + " "

    return _UNSPACED.sub(grams, text).translate(_LETTERS)


_SCRAMBLED, _PLACES = mix64(np.arange(1, 257, dtype=np.uint64)), mix64(np.arange(1001, 1065, dtype=np.uint64))
_ENDS = np.array(sorted(map(ord, ".!?\u2026\u061f\u0964\u3002\uff01\uff1f")), np.uint32)


@dataclass
class Sentences:
    """Sentences of several texts: marks of all tokens with one edge before each and one at the end."""

    marks: np.ndarray
    bounds: np.ndarray  # places of the edges
    first: np.ndarray  # first token of each sentence
    text: np.ndarray  # text of each sentence

    def said(self) -> np.ndarray:
        """Which tokens count: those of two letters or more, less what only repeats the token before it."""
        size = np.diff(self.bounds)
        place = np.arange(self.bounds[-1]) - np.repeat(self.bounds[:-1], size)
        code = np.add.reduceat(_SCRAMBLED[self.marks[:-1]] * _PLACES[place % len(_PLACES)], self.bounds[:-1]) if len(size) else np.zeros(0)
        again = np.concatenate([[False], (code[1:] == code[:-1]) & (size[1:] == size[:-1])])[: len(size)]
        again[self.first] = False
        return (size >= 3) & ~again

    def raw(self) -> list[bytes]:
        """Each sentence's marks, edges included."""
        whole = self.marks.tobytes()
        ends = np.append(self.first[1:], len(self.bounds) - 1)
        return [whole[a : b + 1] for a, b in zip(self.bounds[self.first].tolist(), self.bounds[ends].tolist())]

    @classmethod
    def of_raw(cls, raw: list[bytes]) -> Sentences:
        """Sentences as raw() gives them."""
        marks = np.frombuffer(b"".join([x[:-1] for x in raw]) + b"\0", np.uint8)
        bounds = np.flatnonzero(marks == _EDGE)
        start = np.cumsum([0, *(len(x) - 1 for x in raw)])[:-1]
        return cls(marks, bounds, np.searchsorted(bounds, start), np.arange(len(raw)))


def sentences_of(texts: list[str | None]) -> Sentences:
    cps, starts = code_points(texts)
    marks = mark_table()[cps]
    if (marks == _WIDE).any():
        cps, starts = code_points([unfolded(t or "") for t in texts])
        marks = mark_table()[cps]
    at = np.flatnonzero(marks != _SKIP).astype(np.int32)
    marks = marks[at]
    space = marks == _SPACE
    same = np.concatenate([[False] * 3, marks[3:] == marks[:-3]]) if len(marks) > 3 else np.zeros(len(marks), bool)
    for k in (1, 2):
        same[3:] &= marks[3:] == marks[3 - k : -k]
    # One edge for each run of white space; of a letter written more than three times in a row, three.
    keep = ~(space & np.concatenate([[True], space[:-1]])) & (space | ~same)
    at, marks = at[keep], marks[keep]
    edges = np.flatnonzero(marks == _SPACE)
    bounds = np.concatenate([[-1], edges])
    lengths = np.diff(bounds) - 1
    # Join runs of three or more one-letter tokens of one text: drop the edges inside the run.
    text_of = np.searchsorted(starts, at[edges], side="right") - 1
    run = lengths == 1
    pair = np.zeros(len(edges), bool)
    if len(edges) > 2:
        both = run[:-1] & run[1:] & (text_of[1:] == text_of[:-1])
        triple = both.copy()
        triple[1:] &= both[:-1]
        ok = triple.copy()
        ok[:-1] |= triple[1:]
        pair[:-1] = ok
    drop = edges[pair]
    if len(drop):
        keep = np.ones(len(marks), bool)
        keep[drop] = False
        at, marks = at[keep], marks[keep]
        edges = np.flatnonzero(marks == _SPACE)
        text_of = np.searchsorted(starts, at[edges], side="right") - 1
    # A token begins a sentence if the edge before it follows a sign that ends one, or is a line's end.
    here = at[edges]
    ended = (cps[here] == 10) | np.isin(cps[np.maximum(here - 1, 0)], _ENDS)
    new = np.concatenate([[True], ended[:-1] | (text_of[1:] != text_of[:-1])]) if len(edges) else np.zeros(0, bool)
    nth = np.arange(len(new))
    nth = nth - np.maximum.accumulate(np.where(new, nth, 0))
    first = np.flatnonzero(nth % TOKENS == 0)
    marks = np.concatenate([[_EDGE], np.where(marks == _SPACE, _EDGE, marks)]).astype(np.uint8)
    return Sentences(marks, np.concatenate([[0], edges + 1]), first, text_of[first])


def squared_norm(size: np.ndarray) -> np.ndarray:
    """Squared norm of tokens by their number of marks, edges included: that of their subsequences' weights."""
    return sum(DECAY ** (2 * (s[2] + 1)) * np.maximum(0, size - s[2]) for s in STEPS)


#: Added to a sentence's squared norm (as much as three tokens of six letters), so that short sentences don't count for more.
SHORT = 3 * float(squared_norm(np.array([8]))[0])


def codes_of(marks: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(spread, codes, which of them lie in one token) for every form of a subsequence, by its first mark."""
    n = len(marks)
    size = np.diff(bounds)
    room = np.repeat(bounds[1:], size) - np.arange(bounds[-1])  # places from a mark to its token's closing edge
    reach = np.concatenate([np.minimum(room, ORDER + SKIPS).astype(np.uint8), np.zeros(n - len(room), np.uint8)])
    wide = _VALUES[marks]
    scattered = bool((marks >= _RADIX).any())  # only then codes can go beyond the slots
    firsts, pairs = wide * np.int32(_RADIX), {}
    for a, b, c in STEPS:
        m = n - c
        if m <= 0:
            continue
        if a not in pairs:
            pairs = {a: (firsts[: n - a] + wide[a:]) * np.int32(_RADIX)}  # forms come by a, so one is enough
        code = (pairs[a][:m] + wide[b : b + m]) * np.int32(_RADIX) + wide[c:]
        if scattered:
            code &= np.int32(SLOTS - 1)
        yield c + 1, code, reach[:m] >= c


def token_sums(s: Sentences, weights: np.ndarray) -> np.ndarray:
    """For every token the sum of weights over its subsequences, each by its spread."""
    total = np.zeros(len(s.marks), np.float32)
    for spread, code, inside in codes_of(s.marks, s.bounds):
        found = weights[code]
        found *= np.float32(DECAY**spread)
        found[~inside] = 0
        total[: len(found)] += found
    return np.add.reduceat(total, s.bounds[:-1])


def sentence_sums(s: Sentences, weights: np.ndarray) -> np.ndarray:
    """For every sentence the sum of weights over its subsequences, each by its spread, over the sentence's norm; minus
    infinity for sentences without a token that counts."""
    if not len(s.first):
        return np.zeros(0, np.float32)
    size, said = np.diff(s.bounds), s.said()
    sums = np.where(said, token_sums(s, weights), 0)
    norm = np.add.reduceat(np.where(said, squared_norm(size + 1), 0.0), s.first)
    sums = np.add.reduceat(sums, s.first)
    return np.where(norm > 0, sums / np.sqrt(norm + SHORT), -np.inf)


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsequences of sentences: (sentence, code, weight over the sentence's norm), by code."""
    s = Sentences.of_raw(raw)
    size, said = np.diff(s.bounds), s.said()
    owner = np.repeat(np.arange(len(raw)), np.diff(np.append(s.first, len(size))))  # sentence of each token
    norm = np.sqrt(SHORT + np.bincount(owner, weights=np.where(said, squared_norm(size + 1), 0.0), minlength=len(raw)))
    of_mark = np.append(np.repeat(owner, size), 0)
    kept_mark = np.append(np.repeat(said, size), False)
    keys, values = [], []
    for spread, code, inside in codes_of(s.marks, s.bounds):
        m = np.flatnonzero(inside & kept_mark[: len(inside)])
        keys.append(code[m].astype(np.int64) * len(raw) + of_mark[m])
        values.append(np.full(len(m), DECAY**spread, np.float32))
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(place, weights=np.concatenate(values), minlength=len(key))
    return key % len(raw), key // len(raw), value / norm[key % len(raw)]


def kernel(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Kernel matrix of two lists of sentences: frequent subsequences as dense products, the rest one by one."""
    out = np.zeros((len(left), len(right)), np.float32)
    who, code, value = features(right)
    codes, first, count = np.unique(code, return_index=True, return_counts=True)
    dense = np.sort(codes[np.argsort(-count, kind="stable")[:4096]])

    def in_dense(n: int, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        table, at = np.zeros((n, len(dense)), np.float32), np.minimum(np.searchsorted(dense, x), len(dense) - 1)
        hit = dense[at] == x
        table[w[hit], at[hit]] = y[hit]
        return table

    of_right = in_dense(len(right), who, code, value)
    for a in range(0, len(left), 400):
        own, c, v = features(left[a : a + 400])
        block = (in_dense(min(400, len(left) - a), own, c, v) @ of_right.T).astype(float)
        at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        rest = (codes[at] == c) & ~np.isin(c, dense)
        own, v, at = own[rest], v[rest], at[rest]
        # Every entry of the left meets the entries of its code on the right.
        width = count[at]
        which = np.repeat(np.arange(len(at)), width)
        met = np.repeat(first[at] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        block += np.bincount(own[which] * len(right) + who[met], weights=v[which] * value[met], minlength=block.size).reshape(block.shape)
        out[a : a + len(block)] = block
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; x has one row a sentence, y is +1 or -1."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        xs, cs = x1[inside], cost[inside].astype(x1.dtype)
        new = np.linalg.solve(ridge + (xs * cs[:, None]).T @ xs, xs.T @ (cs * y[inside]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    weights: np.ndarray | None  # one weight for each subsequence of four marks, those of other letters scattered
    bias: float = 0.0
    middle: float = 0.0  # the machine's value that becomes the threshold
    slope: float = 4.0

    def values(self, texts: list[str | None]) -> np.ndarray:
        """The machine's value for the worst sentence of each text; minus infinity where there is none."""
        out = np.full(len(texts), -np.inf)
        s = sentences_of(texts)
        sums = sentence_sums(s, self.weights) + self.bias
        if len(sums):
            first = np.flatnonzero(np.diff(s.text, prepend=-1))
            out[s.text[first]] = np.maximum.reduceat(sums, first)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        z = self.slope * (self.values(texts) - self.middle) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60))) * np.isfinite(z)


@dataclass
class Bags:
    """The different sentences of labelled documents, and for each document which of them it has, in order."""

    sentences: list[bytes]
    start: np.ndarray  # where a document's sentences start in `which`, one more at the end
    which: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Bags:
        index: dict[bytes, int] = {}
        which, sizes = [], np.zeros(len(texts), np.int64)
        for a, b in chunks(texts):
            s = sentences_of(texts[a:b])
            sizes[a:b] = np.bincount(s.text, minlength=b - a)
            which += [index.setdefault(x, len(index)) for x in s.raw()]
        return cls(list(index), np.concatenate([[0], np.cumsum(sizes)]), np.array(which, np.int64))

    def part(self, docs: np.ndarray) -> Bags:
        which = [self.which[self.start[d] : self.start[d + 1]] for d in docs]
        whole = np.concatenate(which) if which else np.zeros(0, np.int64)
        some, place = np.unique(whole, return_inverse=True)
        return Bags([self.sentences[i] for i in some], np.cumsum([0, *map(len, which)]), place)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Value of every different sentence."""
        out = [np.zeros(0)]
        for a in range(0, len(self.sentences), 4000):
            out.append(sentence_sums(Sentences.of_raw(self.sentences[a : a + 4000]), weights))
        return np.concatenate(out)

    def worst(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's highest value, and the first sentence that has it (-1 where there is none)."""
        high, at = np.full(len(self.start) - 1, -np.inf), np.full(len(self.start) - 1, -1)
        for d, (a, b) in enumerate(zip(self.start[:-1], self.start[1:])):
            if b > a:
                own = value[self.which[a:b]]
                k = int(own.argmax())
                high[d], at[d] = own[k], self.which[a + k]
        return high, at

    def counts(self) -> np.ndarray:
        """How often each subsequence occurs; a sentence that comes often counts by the logarithm only (copies)."""
        out = np.zeros(SLOTS)
        often = 1 + np.log2(np.maximum(1, np.bincount(self.which, minlength=len(self.sentences))))
        for a in range(0, len(self.sentences), 4000):
            s = Sentences.of_raw(self.sentences[a : a + 4000])
            tokens = np.diff(np.append(s.first, len(s.bounds) - 1))
            of_mark = np.append(np.repeat(np.repeat(often[a : a + 4000], tokens), np.diff(s.bounds)), 0)
            for _, code, inside in codes_of(s.marks, s.bounds):
                m = np.flatnonzero(inside)
                np.add.at(out, code[m], of_mark[m])
        return out


def evidence(bad: Bags, good: Bags) -> np.ndarray:
    """For each subsequence how much more frequent it is in the sentences of toxic documents (a log ratio, 0 at least)."""
    in_bad, in_good = bad.counts(), good.counts()
    scale = max(1.0, in_good.sum()) / max(1.0, in_bad.sum())
    return np.maximum(0, np.log((in_bad * scale + 2 * max(1.0, scale)) / (in_good + 2 * max(1.0, scale)))).astype(np.float32)


def spread_out(items: list[bytes], most: int) -> list[bytes]:
    """At most so many of the items, evenly chosen."""
    return items if len(items) <= most else [items[i] for i in np.linspace(0, len(items) - 1, most).astype(int)]


def hearts(raw: list[bytes], weights: np.ndarray) -> list[bytes]:
    """Of each sentence the token with the highest sum of weights and one on either side; one for each different such token."""
    out: dict[bytes, bytes] = {}
    for a in range(0, len(raw), 4000):
        s = Sentences.of_raw(raw[a : a + 4000])
        sums = np.where(s.said(), token_sums(s, weights) / np.sqrt(squared_norm(np.diff(s.bounds) + 1) + 1e-9), -np.inf)
        whole, ends = s.marks.tobytes(), np.append(s.first[1:], len(s.bounds) - 1)
        for x, y in zip(s.first.tolist(), ends.tolist()):
            k = x + int(sums[x:y].argmax())
            out.setdefault(whole[s.bounds[k] : s.bounds[k + 1]], whole[s.bounds[max(x, k - 1)] : s.bounds[min(y, k + 2)] + 1])
    return list(out.values())


def machine(positive: list[bytes], times: np.ndarray, negative: list[bytes], marks: list[bytes]) -> ToxicityModel:
    """The machine trained on positive sentences (so many documents picked each) and negative ones, with landmarks marks."""
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    lam, vec = np.linalg.eigh(kernel(marks, marks).astype(float))
    keep = lam > 1e-6 * lam.max()
    root = (vec[:, keep] / np.sqrt(lam[keep])).astype(np.float32)
    cost = np.full(len(y), COST)
    cost[: len(positive)] *= times * (len(negative) / times.sum())
    w, bias = train_svm(kernel([*positive, *negative], marks) @ root, y, cost)
    weights = np.zeros(SLOTS)
    who, code, value = features(marks)
    np.add.at(weights, code, (root @ w)[who] * value)
    return ToxicityModel(weights.astype(np.float32), bias)


def taught(bad: Bags, good: Bags, weights: np.ndarray, draw: np.random.Generator) -> ToxicityModel:
    """The machine after ROUNDS rounds of picking each toxic document's sentence (first by the weights given) and
    training; no threshold yet."""
    drawn = draw.choice(len(good.sentences), min(NEGATIVES, len(good.sentences)), replace=False)
    model = ToxicityModel(None)
    for _ in range(ROUNDS):
        _, at = bad.worst(bad.sums(weights))
        picked, times = np.unique(at[at >= 0], return_counts=True)
        value = good.sums(weights)
        hard = np.argsort(-value, kind="stable")[: NEGATIVES // 2]
        hard = hard[np.isfinite(value[hard])]
        if not len(picked) or not len(hard):
            return ToxicityModel(None)
        positive = [bad.sentences[i] for i in picked]
        marks = spread_out(hearts(positive, weights), LANDMARKS // 2)
        marks += spread_out(hearts([good.sentences[i] for i in hard], weights), LANDMARKS // 4)
        marks += [good.sentences[i] for i in drawn[: LANDMARKS - len(marks)]]
        model = machine(positive, times, [good.sentences[i] for i in np.union1d(hard, drawn)], list(dict.fromkeys(marks)))
        weights = model.weights
    return model


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> ToxicityModel:
    bad = Bags.of([t for t, y in zip(texts, toxic) if y])
    good = Bags.of([t for t, y in zip(texts, toxic) if not y])
    if not bad.sentences or not good.sentences:
        return ToxicityModel(None)
    draw = np.random.default_rng(seed)
    first = evidence(bad, good)
    model = taught(bad, good, first, draw)
    if model.weights is None:
        return model
    trim()
    # The threshold that errs least on documents rated by machines that have not seen them.
    value, truth = [], []
    folds = [(np.arange(len(b.start) - 1) * 7919 + 13) % FOLDS for b in (bad, good)]
    for k in range(FOLDS):
        own = taught(bad.part(np.flatnonzero(folds[0] != k)), good.part(np.flatnonzero(folds[1] != k)), first, draw)
        for b, fold, y in ((bad, folds[0], 1), (good, folds[1], 0)):
            unseen = b.part(np.flatnonzero(fold == k))
            if own.weights is not None and unseen.sentences:
                high, _ = unseen.worst(unseen.sums(own.weights) + own.bias)
                value.append(high[np.isfinite(high)])
                truth.append(np.full(len(value[-1]), y))
    if value:
        v, t = np.concatenate(value), np.concatenate(truth)
        order = np.argsort(-v, kind="stable")
        right = np.cumsum(np.where(t[order] > 0, 1.0, -FALSE))
        k = int(np.argmax(right))
        under = v[order[k + 1]] if k + 1 < len(order) else v[order[k]] - 1
        model.middle = float((v[order[k]] + max(under, v[order[k]] - 1)) / 2)
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", per_label: int = SAMPLE_PER_LABEL, most_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Model from about per_label labelled documents of either label, and most_bytes of their texts.

    The sample is drawn from the labels, so that the join with the texts has a small side of bounded size.
    """
    lean()
    rows = labels.select(F.col(quoted(key)).alias("k"), F.col(quoted(toxic)).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull())
    drawn = F.broadcast(bounded_sample(rows, "y", "k", per_label, "toxicity"))
    found = sampled_texts(docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("t")).join(drawn, "k"), most_bytes)
    texts, toxic_ones = [t for _, _, t in found], [y for _, y, _ in found]
    del found
    model = fit(texts, toxic_ones)
    del texts
    trim()
    return model


def score(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """df with toxicity (0 to 1); every column of df stays."""
    kept = [c for c in df.columns if c != "toxicity"]
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*map(quoted, kept))
    schema = StructType([*rows.schema.fields, StructField("toxicity", DoubleType())])
    where = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            found = [fitted.scores(texts) for _, _, texts in text_chunks(batch, where)]
            found = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=schema.names)
        trim()

    return numbered(rows).mapInArrow(run, schema)
