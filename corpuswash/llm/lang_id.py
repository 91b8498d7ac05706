"""Language of texts and of their parts: script ranges, per-word scores, Viterbi with a switching penalty.

A model is learned from labelled texts: for every language the smoothed log likelihood of hashed letter trigrams
(word edges included), and the scripts whose letters it uses.  A text is cut into words (runs of letters).  A
word's script narrows the candidate languages; its score for each is the sum over its trigrams.  Viterbi over
the words, with a penalty for each change of language, labels spans.  The document's language is the one with
most letters; ``score`` is its share of the letters, times how far its words prefer it to the next language.

Defined results: null text, or text without a letter, is ``und`` with score 0 and no spans; with nothing to
learn from every text is ``und``; ties go to the language first in code point order; very long texts are read whole, one at
a time; repeated rows stay; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import bounded_sample, chunks, code_points, numbered, own_names, quoted, sampled_texts, text_chunks, trim

#: Texts learned from, about so many for each language, and their bytes.
SAMPLE_PER_LANGUAGE, SAMPLE_BYTES = 500, 4 << 20
#: Buckets of the trigram tables; cost of a change of language in nats.
BUCKETS, PENALTY = 1 << 16, 8.0

#: First code points of runs of one script, by the Unicode block charts (fixed values).
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("ipa", 0x0250, 0x02FF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case form where that is one code point and a letter, else 0; its script."""
    lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            lower[cp] = ord(low) if len(low) == 1 else cp
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return lower, script


@dataclass
class Words:
    """Words of several texts: letters in one array, where words start in it and in the text, their text and script."""

    buckets: np.ndarray
    first: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    script: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    lower, script = letter_tables()
    cps, starts = code_points(texts)
    low = lower[cps]
    padded = np.zeros(len(low) + 2, np.uint32)
    padded[1:-1] = low
    at = np.flatnonzero(low)
    here, left, right = padded[at + 1], padded[at], padded[at + 2]
    h = here * np.uint32(0x9E3779B1) + left * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    buckets = (h >> np.uint32(16)).astype(np.intp)
    first = np.flatnonzero(left == 0)
    start = at[first]
    length = np.diff(np.append(first, len(at)))
    text = np.searchsorted(starts, start, side="right") - 1
    return Words(buckets, first, start, length, text, script[cps[start]])


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, log likelihoods less their mean over the languages
    allowed: np.ndarray  # scripts x languages, True where the language uses the script

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> LanguageModel:
        languages = sorted(set(labels))
        counts = np.zeros((len(languages), BUCKETS))
        scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
        for k, lang in enumerate(languages):
            own = [t for t, y in zip(texts, labels) if y == lang]
            for a, b in chunks(own):
                w = words_of(own[a:b])
                counts[k] += np.bincount(w.buckets, minlength=BUCKETS)
                scripts[:, k] += np.bincount(w.script, weights=w.length, minlength=len(SCRIPT_NAMES))
        logs = np.log((counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * BUCKETS)) if languages else counts
        allowed = scripts > 0.01 * np.maximum(scripts.sum(0, keepdims=True), 1)
        allowed[~allowed.any(1)] = True  # a script that no language uses rules none out
        table = (logs - logs.mean(0, keepdims=True)).T if languages else logs.T
        return cls(languages, np.ascontiguousarray(table, np.float32), allowed)


def word_scores(model: LanguageModel, w: Words) -> np.ndarray:
    if not len(w.first):
        return np.zeros((0, len(model.languages)), np.float32)
    scores = np.add.reduceat(model.table[w.buckets], w.first, axis=0)
    scores[~model.allowed[w.script]] = -1e4
    return scores


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, penalty: float = PENALTY) -> np.ndarray:
    """Best label of every word; all texts advance together, one word a step."""
    labels = np.zeros(len(scores), np.int16)
    if scores.shape[1] < 2 or not len(scores):
        return labels
    count = np.bincount(text, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    order = np.argsort(-count, kind="stable")
    count, begin = count[order], begin[order]
    alive = np.searchsorted(-count, -np.arange(count[0]), side="left")  # texts with more than t words
    back = np.zeros(scores.shape, np.int8 if scores.shape[1] <= 127 else np.int16)
    own = np.arange(scores.shape[1], dtype=back.dtype)
    value = scores[begin[: alive[0]]].astype(np.float64)
    end = np.zeros(len(order), np.int64)
    for t in range(1, count[0]):
        k = alive[t]
        if k < len(value):
            end[k : len(value)] = value[k:].argmax(1)
            value = value[:k]
        rows = begin[:k] + t
        best = value.argmax(1)
        top = value[np.arange(k), best][:, None] - penalty
        stay = value >= top
        back[rows] = np.where(stay, own, best[:, None])
        value = np.where(stay, value, top) + scores[rows]
    end[: len(value)] = value.argmax(1)
    state = np.zeros(len(order), np.int64)
    for t in range(count[0] - 1, -1, -1):
        k = alive[t]
        old = alive[t + 1] if t + 1 < count[0] else 0
        state[old:k] = end[old:k]
        rows = begin[:k] + t
        labels[rows] = state[:k]
        state[:k] = back[rows, state[:k]]
    return labels


def label(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Languages, scores, and the spans: numbers of spans per text, then their start, end and label arrays."""
    n, k = len(texts), len(model.languages)
    w = words_of(texts)
    if k == 0 or not len(w.first):
        return ["und"] * n, np.zeros(n), np.zeros(n, np.int64), [np.zeros(0, np.int64)] * 3
    scores = word_scores(model, w)
    tags = viterbi(scores, w.text, n)
    letters = np.bincount(w.text * k + tags, weights=w.length, minlength=n * k).reshape(n, k)
    total, best = letters.sum(1), letters.argmax(1)
    in_best = tags == best[w.text]
    ranked = np.sort(np.clip(scores, -50, 50), axis=1)
    margin = np.where(in_best, (ranked[:, -1] - ranked[:, -2]) if k > 1 else 1.0, 0.0)
    margin = np.bincount(w.text, weights=margin, minlength=n)
    score = np.where(total > 0, letters.max(1) / np.maximum(total, 1) * (1 - np.exp(-1 - margin)), 0.0)
    _, starts = code_points(texts)
    new = np.flatnonzero(np.diff(w.text, prepend=-1).astype(bool) | np.diff(tags, prepend=-1).astype(bool))
    last = np.append(new[1:], len(tags)) - 1
    offset = starts[w.text[new]]
    spans = [w.start[new] - offset, w.start[last] + w.length[last] - offset, tags[new].astype(np.int64)]
    langs = [model.languages[b] if t else "und" for b, t in zip(best, total)]
    return langs, score, np.bincount(w.text[new], minlength=n), spans


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Model from about per_language rows of each label and SAMPLE_BYTES of their texts; null texts and labels teach nothing."""
    rows = labelled.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("t"), F.col(quoted(lang)).alias("y")).dropna(subset=["t", "y"])
    found = sorted((y, k, t) for k, y, t in sampled_texts(bounded_sample(rows, "y", "k", per_language, "lang-id"), SAMPLE_BYTES))
    return LanguageModel.fit([t for _, _, t in found], [y for y, _, _ in found])


def identify(df: DataFrame, model: LanguageModel, keys: list[str], text: str = "text") -> DataFrame:
    """keys, lang_pred, score, and spans (array of start, end, lang; code points, end exclusive)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    (said,) = own_names(keys, "text")
    rows = df.select(*map(quoted, keys), F.col(quoted(text)).alias(said))
    span_type = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("lang", StringType())])
    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(span_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        names = pa.array([*fitted.languages, "und"])
        for batch in batches:
            for a, b, texts in text_chunks(batch, batch.num_columns - 1):
                langs, score, n_spans, (start, end, tag) = label(fitted, texts)
                offsets = np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)
                span = pa.StructArray.from_arrays([pa.array(start), pa.array(end), names.take(pa.array(tag))], names=["start", "end", "lang"])
                out = [batch.column(i).slice(a, b - a) for i in range(len(keys))]
                out += [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), span)]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)
        trim()

    return numbered(rows).mapInArrow(run, schema)
