"""Keyphrases of a text by itself: no corpus, no model.

A word matters by case, place, frequency, spread over sentences and how many different neighbours it has; a small
weight is good. With tf its occurrences, of which c are written with a capital inside a sentence or in capitals alone (the larger count),
s the mean number of its sentences (from 0), k of all n sentences, and l and r the shares of different left and right neighbours among all,

    case = c / (1 + ln tf)     place = ln(ln(3 + s))     often = tf / (mean + standard deviation of tf)
    near = 1 + (l + r) * tf / (largest tf)     spread = k / n     weight = place * near / (case + (often + spread) / near)

over words that are informative. A phrase of up to MOST such words that follow each other in a sentence has
product(weights) / ((1 + sum(weights)) * its own occurrences). Phrases too much like a better one are left out.

Texts are dealt out evenly and worked out by Arrow batches: words, weights and phrases of all texts of a batch at once, in arrays of numbers; only the best phrases of each are made.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.sources.store import lean

MOST, ALIKE = 3, 0.9
KIND = "array<struct<phrase: string, score: double>>"


_PLAIN, _SHORT = frozenset((*T.STOP_TERMS, *T.CODE_TERMS)), frozenset(T.SHORT_TERMS)


@lru_cache(maxsize=1 << 16)
def informative(word: str) -> bool:
    """As ``text.is_informative``, for words of letters and digits."""
    w = word.replace("ё", "е")
    return (len(w) >= 3 or w in _SHORT) and len(w) <= 64 and w not in _PLAIN and not w.isnumeric() and (w[0].isalpha() or any(c.isalpha() for c in w))


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts as written, and of each the number of its text and of its sentence (over all texts, those without words left out)."""
    parts = pc.split_pattern_regex(texts, r"[.!?\n]+")
    words = pc.split_pattern_regex(parts.flatten(), r"[^\p{L}\p{N}]+")
    count = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    sentence = np.repeat(np.arange(len(words)), count(words))
    doc = np.repeat(np.arange(len(texts)), count(parts))[sentence]
    words = words.flatten()
    keep = pc.not_equal(words, "")
    held = keep.to_numpy(zero_copy_only=False)
    sentence = sentence[held]
    return words.filter(keep), doc[held], np.cumsum(np.diff(sentence, prepend=sentence[:1]) > 0)


def _different(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each number below ``size``, how many different b stand with it as a."""
    if not len(a):
        return np.zeros(size, np.int64)
    both = np.sort(a * (int(b.max()) + 1) + b)
    return np.bincount(both[np.diff(both, prepend=-1) > 0] // (int(b.max()) + 1), minlength=size)


def _weights(tokens: pa.Array, doc: np.ndarray, sentence: np.ndarray, docs: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words in lower case; the text, the word and the weight (no number: not informative) of each entry, which is a word of a text; and the entry of each token."""
    coded = tokens.dictionary_encode()
    written, as_written = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    low: dict[str, int] = {}
    of = np.array([low.setdefault(w.lower(), len(low)) for w in written], np.int64)
    entries, ids = np.unique(doc * len(low) + of[as_written], return_inverse=True)
    size, (own, word) = len(entries), np.divmod(entries, len(low))
    out = np.full(size, np.nan)
    count = lambda part: np.bincount(part, minlength=size)
    shouts = np.array([len(w) > 1 and w.isupper() for w in written])[as_written]
    capitals = np.array([w[0].isupper() and not (len(w) > 1 and w.isupper()) for w in written])[as_written]
    after = sentence[1:] == sentence[:-1]  # whether a word follows in its sentence
    left, right = ids[:-1][after], ids[1:][after]
    first = np.searchsorted(doc, np.arange(docs))  # each text's first token
    place = sentence - sentence[np.minimum(first, len(sentence) - 1)][doc]
    n = np.bincount(doc[np.diff(sentence, prepend=-1) > 0], minlength=docs)
    tf, case = count(ids), np.maximum(count(ids[1:][after & capitals[1:]]), count(ids[shouts]))
    total, held = np.bincount(ids, place, size), _different(ids, sentence, size)
    share = _different(right, left, size) / np.maximum(1, count(right)) + _different(left, right, size) / np.maximum(1, count(left))
    good = np.flatnonzero(np.array([informative(w) for w in low])[word])
    d, t = own[good], tf[good]
    some = np.maximum(1, np.bincount(d, minlength=docs))
    mean = np.bincount(d, t, docs) / some
    usual = mean + np.sqrt(np.bincount(d, (t - mean[d]) ** 2, docs) / some)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, d, t)
    near = 1 + share[good] * t / most[d]
    out[good] = np.log(np.log(3 + total[good] / t)) * near / (case[good] / (1 + np.log(t)) + (t / usual[d] + held[good] / n[d]) / near)
    return list(low), own, word, out, ids


def word_weights(sentences: list[list[str]]) -> dict[str, float]:
    """The weight of each informative word (lower case) of sentences (words as written)."""
    tokens = pa.array([w for words in sentences for w in words], pa.string())
    if not len(tokens):
        return {}
    low, _, word, weight, _ = _weights(tokens, np.zeros(len(tokens), np.int64), np.repeat(np.arange(len(sentences)), [len(words) for words in sentences]), 1)
    return {low[w]: x for w, x in zip(word.tolist(), weight.tolist(), strict=True) if x == x}


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or any number over ``most`` where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # what both begin and end with costs nothing
    low = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[low:], b[low:]
    high = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - high], b[: len(b) - high]
    if not a or not b or not most:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def too_alike(a: str, b: str, alike: float) -> bool:
    """Whether 1 - distance / (letters of the longer) is over ``alike``."""
    size = max(len(a), len(b))
    most = int((1 - alike) * size + 1e-9)
    return 1 - _distance(a, b, most) / size > alike


def keyphrases(text: str, count: int, most: int = MOST, alike: float = ALIKE, highest: float | None = None) -> list[tuple[str, float]]:
    """The ``count`` best phrases of a text with their scores, best first (to nine digits, then by letters). highest: the worst score that is still good."""
    return of_texts(pa.array([text], pa.string()), count, most, alike, highest)[0]


def of_texts(texts: pa.Array, count: int, most: int = MOST, alike: float = ALIKE, highest: float | None = None) -> list[list[tuple[str, float]]]:
    """``keyphrases`` of each text."""
    tokens, doc, sentence = _tokens(texts)
    if not len(tokens):
        return [[] for _ in texts]
    low, own, word, weight, ids = _weights(tokens, doc, sentence, len(texts))
    words, scores = _phrases(ids, sentence, weight, most)
    of = own[words[:, 0]]
    order = np.argsort(of, kind="stable")  # a few runs that are in order
    words, scores = np.where(words < 0, -1, word[words])[order], scores[order]
    ends = np.searchsorted(of[order], np.arange(len(texts) + 1)).tolist()
    return [_best(words[a:b], scores[a:b], low, count, alike, highest) for a, b in zip(ends, ends[1:], strict=False)]


def _best(words: np.ndarray, scores: np.ndarray, low: list[str], count: int, alike: float, highest: float | None) -> list[tuple[str, float]]:
    """The best of a text's phrases."""
    order = np.argsort(scores, kind="stable")
    ranked, some = scores[order], 4 * count
    while True:
        # scores to nine digits and words only of the best; as many more as are left out for being alike
        cut = ranked[some - 1] if some < len(order) else np.inf
        near = order[: np.searchsorted(ranked, cut + 2e-9, "right")] if some < len(order) else order
        best = sorted((round(s, 9), " ".join([low[w] for w in ws if w >= 0])) for s, ws in zip(scores[near].tolist(), words[near].tolist(), strict=True))
        out: list[tuple[str, float]] = []
        for score, phrase in best:
            if len(out) == count or highest is not None and score > highest:
                return out
            if some < len(order) and score > round(cut, 9):
                break
            if alike >= 1 or not any(too_alike(phrase, p, alike) for p, _ in out):
                out.append((phrase, score))
        if len(out) == count or some >= len(order):
            return out
        some *= 8


def _phrases(ids: np.ndarray, sentence: np.ndarray, weight: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different phrases, as rows of ``most`` entries (-1: none), and their scores. An entry is a word of one text, so texts share no phrase."""
    good = ~np.isnan(weight[ids])
    start, key, rows, scores = np.flatnonzero(good), ids, [], []
    for n in range(1, most + 1):
        if n > 1:  # those of a word less that a good word of the same sentence follows
            start = start[start + n - 1 < len(ids)]
            start = start[good[start + n - 1] & (sentence[start] == sentence[start + n - 1])]
        if not len(start):
            break
        # a phrase's key is the number of the phrase without its last word, and that word
        _, first, number, tf = np.unique(key[start] * len(weight) + ids[start + n - 1] if n > 1 else ids[start], return_index=True, return_inverse=True, return_counts=True)
        key = np.zeros(len(ids), np.int64)
        key[start] = number
        held = np.full((len(first), most), -1)
        product, total = np.ones(len(first)), np.zeros(len(first))
        for k in range(n):
            held[:, k] = ids[start[first] + k]
            product, total = product * weight[held[:, k]], total + weight[held[:, k]]
        rows.append(held)
        scores.append(product / ((1 + total) * tf))
    return (np.concatenate(rows), np.concatenate(scores)) if rows else (np.zeros((0, most), np.int64), np.zeros(0))


def column(text: Column, count: int = 8, most: int = MOST, alike: float = ALIKE, highest: float | None = None) -> Column:
    """The keyphrases of each text, as a list of structs; none for null, and for texts of under 20 letters."""

    def found(text: pa.Array) -> pa.Array:
        long = pa.array([bool(t) and len(" ".join(t.split())) >= 20 for t in text.to_pylist()], pa.bool_())
        rows = [[{"phrase": p, "score": s} for p, s in best] for best in of_texts(pc.if_else(long, text, ""), count, most, alike, highest)]
        return pa.array(rows, pa.list_(pa.struct([("phrase", pa.string()), ("score", pa.float64())])))

    lean()
    return F.arrow_udf(found, KIND)(text)


def of_documents(docs: DataFrame, count: int = 8, **how) -> DataFrame:
    """(doc_id, phrase, score, rank) of documents (doc_id, text). Texts are dealt out first: a small file has few parts, and a text is much work."""
    even = docs.select("doc_id", "text").repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)
    rows = even.select("doc_id", F.posexplode(column(F.col("text"), count, **how)).alias("at", "k"))
    return rows.select("doc_id", "k.phrase", "k.score", (F.col("at") + 1).cast("long").alias("rank"))
