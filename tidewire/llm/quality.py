"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

A text's tokens are its runs of letters, of digits and of other signs; its features
are the hashes of single tokens and of neighbouring pairs, folded to ``2**bits``
places, each with its count over the root of the number of tokens. A score is one
sparse dot product and a bias through the logistic function.

Fitting reads a bounded sample: the ``sample`` labelled rows of smallest
``xxhash64(doc_id)``, so the model and the driver's memory have one size at any
scale. Only these few ids are broadcast; a row comes to the driver as its distinct places, so the
longest text takes 8 * 2**bits bytes. Scores are made for every row and whole text.

Nulls and empty texts have no tokens: their score is that of the bias alone. With no
usable label the score is 0.5, with labels of one kind the bias learns it. Repeated
rows are scored alike; repeated labels of a document count once (the highest).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.store import lean

KIND = np.full(256, 3, np.uint8)
KIND[K.SPACE] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of one kind of sign, and the place of each text's first."""
    data, offsets = K.view(column)
    if not len(data):
        return np.zeros(0, K.U), np.zeros(len(offsets), np.int64)
    kind = KIND[data]
    turn = np.empty(len(data), bool)
    turn[0] = True
    turn[1:] = kind[1:] != kind[:-1]
    turn[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(turn)
    ends = np.append(at[1:], len(data))
    ink = kind[at] > 0
    starts = at[ink]
    return K.hashes(data, starts, ends[ink]), np.searchsorted(starts, offsets)


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (0 to 2**bits - 1) of the texts' one- and two-token features, each text's after the other's, and the bounds by text."""
    h, bounds = tokens(column)
    n = np.diff(bounds)
    fold = K.U(64 - bits)
    with np.errstate(over="ignore"):
        one = (h >> fold).astype(np.int64)
        two = (K.mix(h[:-1] * K.U(3) + h[1:]) >> fold).astype(np.int64)
    pairs = np.maximum(n - 1, 0)
    out_at = np.concatenate([[0], np.cumsum(n + pairs)])
    out = np.empty(int(out_at[-1]), np.int64)
    for part, count, shift in ((one, n, 0), (two, pairs, n)):
        total = int(count.sum())
        if total:
            rel = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            out[rel + np.repeat(out_at[:-1] + shift, count)] = part[rel + np.repeat(bounds[:-1], count)]
    return out, out_at


class Follow:
    """Follow-the-regularised-leader (proximal) for logistic loss, McMahan et al. 2013. The last place is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def in_training(doc_id: Column) -> Column:
    """Whether labels of this row may be learnt: crc32 of the id as text, mod 5, isn't 0. A null id's labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def sample_labels(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most ``sample`` rows (doc_id, y): the training rows of smallest id hash."""
    rows = labels.where(in_training(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int, made: Column) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sample's labels and int32 arrays (views of one Arrow table) on the driver, in one order whatever the partitions; ``sample`` bounds what is broadcast and collected."""
    few = F.broadcast(sample_labels(labels, label, sample))
    got = docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "y", made.alias("made")).toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    cells = [x for chunk in got["made"].chunks for x in chunk]
    return got["y"].to_numpy()[order].astype(float), [np.frombuffer(cells[i].as_buffer(), np.int32) for i in order]


def packed(bits: int) -> Callable:
    """UDF: a text's distinct feature places and counts, as int32 pairs in binary."""

    @F.arrow_udf("binary")
    def pack(text: pa.Array) -> pa.Array:
        out = []
        for a, b in K.steps(text):
            got, at = features(text.slice(a, b - a), bits)
            for i in range(b - a):
                place, count = np.unique(got[at[i] : at[i + 1]], return_counts=True)
                out.append(np.stack([place, count]).astype(np.int32).tobytes())
        return pa.array(out, pa.binary())

    return pack


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = 18, sample: int = 4096, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """Weights (float32, 2**bits places and the bias). ``sample`` is the bound of labelled rows that are learnt."""
    y, rows = sampled(docs, labels, label, sample, packed(bits)(F.col("text")))
    model, bias = Follow(1 << bits), np.array([1 << bits])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            place, count = rows[i].reshape(2, -1)
            model.update(np.concatenate([place, bias]), np.append(count / np.sqrt(max(1, count.sum())), 1.0), y[i])
    weights = model.weights(slice(None)).astype(np.float32)
    del rows
    pa.default_memory_pool().release_unused()
    return weights


def scorer(weights: np.ndarray, bits: int = 18) -> Callable:
    """UDF: score (0 to 1) of a text."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = []
        for a, b in K.steps(text):
            got, at = features(text.slice(a, b - a), bits)
            n = np.maximum(np.diff(at), 1)
            s = K.sums(weights[got].astype(np.float64), at) / np.sqrt(n) + float(weights[-1])
            out.append(1 / (1 + np.exp(-np.clip(s, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    score = scorer(fit(lean(docs), labels, label, **how), how.get("bits", 18))
    made = docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), score(F.col("text")).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``. Labels only fit the model; they never decide a row."""
    score = scorer(fit(lean(docs), labels, **how), how.get("bits", 18))
    return docs.where(score(docs["text"]) >= threshold)
