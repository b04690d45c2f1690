"""Toxicity: noisy-channel restoration of disguised words, then a classifier on the restored text.

Disguises are look-alike signs (1d10t), signs or blanks between letters (i d i o t, i.d.i.o.t)
and repetition (idiiiot). Words that may be disguised are decoded by Viterbi search
over a lattice: each sign may stand for itself, for letters it looks like, or for nothing
(a separator, a repeated letter), at fixed channel costs; a language model of letter
trigrams says which reading is likely. Its counts cover every text of the corpus: each
task sums its own table of at most SYMBOLS**3 counts. Other words are as they were. The search is exact: it keeps every
state (the last two symbols and the last letter read), of which few are alive at a sign, for a sign stands for few letters;
words and runs are decoded whole, at any length.

The score is a logistic regression on the presence of hashed words of the restored text,
fitted by follow-the-regularised-leader updates on a bounded sample of labelled rows
(``sample``, a parameter; see quality.py). Scores use the text alone.

Null and empty texts have no words: their score is the bias alone. Without labels it is 0.5.
Repeated rows are scored alike. An empty corpus makes a model of even chances.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm import quality
from tidewire.llm.store import lean

#: Blank, a to z, and one symbol for all other letters.
SYMBOLS = 28
_SYMBOL = np.full(256, 0, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:256] = 27
#: The letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Costs (negative natural logarithms) of the channel: a letter as it is, a look-alike, a repeated letter left out, a separator left out, any other sign left out, a separator read as a blank.
KEEP, LIKE, REPEAT, SEPARATOR, BORDER, BLANK = 0.05, 1.0, 2.0, 0.5, 10.0, 4.0
LONGEST = 48

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LIKE = np.zeros(256, bool)
_LIKE[[ord(c) for c in LOOKALIKES]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in "._-*~'"]] = True


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: a task's counts (code, n) of letter trigrams over whole texts."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        text = batch.column(0)
        for a, b in K.steps(text):
            data, offsets = K.view(text.slice(a, b - a))
            # two blanks between texts, and runs of one blank within
            s = _SYMBOL[data]
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
            keep[offsets[:-1][np.diff(offsets) > 0]] = True
            s = s[keep]
            s = np.concatenate([[0, 0], s, [0]])
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs of the third symbol after two (SYMBOLS x SYMBOLS x SYMBOLS), interpolated with shorter contexts."""
    rows = docs.select("text").mapInArrow(trigram_counts, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()  # SYMBOLS**3 at most
    c = np.zeros(SYMBOLS**3)
    for r in rows:
        c[r["code"]] = r["n"]
    c = c.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    three = (c + 1e-9) / (c.sum(axis=2, keepdims=True) + 1e-9 * SYMBOLS)
    two = c.sum(axis=0) + 0.5
    two /= two.sum(axis=1, keepdims=True)
    one = c.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    trust = c.sum(axis=2, keepdims=True)
    trust = trust / (trust + 50)
    return -np.log(trust * 0.9 * three + (1 - trust * 0.9) * (0.85 * two[None] + 0.15 * one[None, None]))


class Decoder:
    """Viterbi search; the state is the last two symbols and the last letter read."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.remembered = lru_cache(maxsize=200_000)(self._decode)

    def decode(self, token: str) -> str:
        """The likeliest reading; those of words of up to LONGEST signs are remembered."""
        return self.remembered(token) if len(token) <= LONGEST else self._decode(token)

    def _decode(self, token: str) -> str:
        # state: (symbol before, last symbol, last letter) -> (cost, chain of letters, last first)
        best: dict = {(0, 0, ""): (0.0, None)}
        for sign in token.lower():
            letters = [(sign, KEEP)] if sign.isalpha() else [(x, LIKE) for x in LOOKALIKES.get(sign, "")]
            step: dict = {}
            for (x, y, last), (cost, out) in best.items():
                for letter, channel in letters:
                    z = ord(letter) - 96 if "a" <= letter <= "z" else 27
                    total = cost + channel + self.costs[x][y][z]
                    key = (y, z, letter)
                    if key not in step or total < step[key][0]:
                        step[key] = (total, (out, letter))
                    if letter == last and cost + channel + REPEAT < step.get((x, y, last), (math.inf,))[0]:
                        step[x, y, last] = (cost + channel + REPEAT, out)
                if not sign.isalpha():
                    free = sign in " ._-*~'"
                    total = cost + (SEPARATOR if free else BORDER)
                    if total < step.get((x, y, last), (math.inf,))[0]:
                        step[x, y, last] = (total, out)
                    total = cost + (BLANK if free else BORDER) + self.costs[x][y][0]
                    if y and total < step.get((y, 0, ""), (math.inf,))[0]:
                        step[y, 0, ""] = (total, (out, " "))
            best = step
        out = min(((c + self.costs[x][y][0], out) for (x, y, _), (c, out) in best.items()), key=lambda r: r[0], default=(0.0, None))[1]
        letters = []
        while out:
            out, letter = out
            letters.append(letter)
        return "".join(reversed(letters))


#: What frames a word: punctuation, and signs that are repeated at its end.
_FRAME = re.compile(r"""^[.,;:?"'()\[\]{}\-_*~!]+|(?:[.,;:?"'()\[\]{}\-_*~!]|([^\w\s])\1+)+$""")


def suspects(column: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(row, start byte, end byte within the row) of words and runs of single letters that may be disguised, in order."""
    data, offsets = K.view(column)
    first, last = K.spans(data, offsets)
    if not len(first):
        return
    letter, mark = _LETTER[data], _LIKE[data] | _SEPARATOR[data]
    inner = np.zeros(len(data), bool)  # a mark after a letter or at the start, before a letter or mark
    inner[:-1] = mark[:-1] & (letter[1:] | mark[1:])
    closed = offsets[1:][np.diff(offsets) > 0] - 1  # last bytes: what follows is another text's
    inner[closed] = False
    three = np.zeros(len(data), bool)  # a letter (code point, not byte) three times
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kinds, kind = np.unique(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), return_inverse=True)
    low = np.array([ord(c) if len(c := chr(x).lower()) == 1 else x for x in kinds])[kind]
    alpha = np.array([chr(x).isalpha() for x in kinds])[kind]
    text = np.searchsorted(offsets, at, "right")
    three[at[:-2]] = (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & alpha[:-2] & (text[:-2] == text[2:])
    count = lambda flags: np.add.reduceat(flags, first) if len(first) else np.zeros(0)  # noqa: E731  blanks between words are no flags
    size = last - first
    letters, marks = count(letter.astype(np.int32)), count(inner.astype(np.int32))
    odd = (letters > 0) & (marks > 0) & (marks + letters + 2 >= size) | (count(three.astype(np.int32)) > 0)
    closing = np.isin(data[last - 1], np.frombuffer(b".,;:!?", np.uint8)) & (size == 2)
    single = ((size == 1) | closing) & (letter[first] | _LIKE[data[first]])
    row = np.searchsorted(offsets, first, "right") - 1
    # runs of three single signs and more
    edge = np.flatnonzero(np.diff(single.astype(np.int8), prepend=0, append=0))
    found = [(i, i + 1) for i in np.flatnonzero(odd & ~single)]
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        cuts = [a, *(np.flatnonzero(np.diff(row[a:b])) + a + 1), b]
        for s, t in zip(cuts, cuts[1:], strict=False):
            if t - s >= 3:
                found.append((s, t))
    for i, j in sorted(found):
        r = int(row[i])
        yield r, int(first[i] - offsets[r]), int(last[j - 1] - offsets[r])


def restored(column: pa.Array, decoder: Decoder) -> pa.Array:
    """The texts with each suspect word replaced by its likeliest reading; nulls become empty."""
    column = K.plain(column).fill_null("")
    changes: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in suspects(column):
        changes.setdefault(r, []).append((a, b))
    if not changes:
        return column
    out = column.to_pylist()
    for r, cuts in changes.items():
        raw, parts, at = out[r].encode(), [], 0
        for a, b in cuts:
            word = raw[a:b].decode()
            # what frames a word stays
            core = _FRAME.sub("", word)
            start = word.find(core) if core else 0
            parts += [raw[at:a].decode(), word[:start], decoder.decode(core) if core else "", word[start + len(core) :]]
            at = b
        out[r] = "".join(parts) + raw[at:].decode()
    return pa.array(out, pa.large_string() if sum(map(len, out)) > 1 << 29 else pa.string())


#: Lengths, in bytes, of the beginnings of words that are features beside whole words.
HEADS = (4, 5, 6, 7, 8)


def presence(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places (0 to 2**bits - 1) of each text's letter runs and of their beginnings, A-Z lower-cased, and the bounds by text."""
    data, offsets = K.view(text)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = _LETTER[data]
    turn = np.ones(len(data), bool)
    turn[1:] = letter[1:] != letter[:-1]
    turn[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(turn)
    ends = np.append(starts[1:], len(data))[letter[starts]]
    starts = starts[letter[starts]]
    low = K.LOWER[data]
    row = np.searchsorted(offsets, starts, "right") - 1
    # a word once a text
    whole = K.hashes(low, starts, ends)
    _, one = np.unique(K.mix(whole + row.astype(K.U) * K._COEF[50]), return_index=True)
    starts, ends, row = starts[one := np.sort(one)], ends[one], row[one]
    cells = [row << bits | (whole[one] >> K.U(64 - bits)).astype(np.int64)]
    for k in HEADS:
        long = ends - starts > k
        h = K.hashes(low, starts[long], starts[long] + k)
        cells.append(row[long] << bits | (K.mix(h + K.U(k)) >> K.U(64 - bits)).astype(np.int64))
    seen = np.unique(np.concatenate(cells))
    return seen & ((1 << bits) - 1), np.searchsorted(seen >> bits, np.arange(len(offsets)))


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, bits: int = 20, sample: int = 8192, least: int = 6, epochs: int = 10, seed: int = 7) -> np.ndarray:
    """Weights (float32, 2**bits places and the bias) from at most ``sample`` labelled rows."""

    def pack(text: pa.Array) -> pa.Array:
        decoder, out = Decoder(costs), []
        for a, b in K.steps(text):
            got, at = presence(restored(text.slice(a, b - a), decoder), bits)
            out += [got[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
        return pa.array(out, pa.binary())

    y, rows = quality.sampled(docs, labels, "toxic", sample, F.arrow_udf(pack, "binary")(F.col("text")))
    weights = learn(rows, y, bits, least, epochs, seed)
    del rows
    pa.default_memory_pool().release_unused()
    return weights


def learn(parsed: list[np.ndarray], y: np.ndarray, bits: int, least: int, epochs: int, seed: int) -> np.ndarray:
    """Weights from feature places and labels; a feature of fewer than ``least`` rows isn't used."""
    seen = np.zeros(1 << bits, np.int32)
    for at in parsed:
        seen[at] += 1  # a row's places are distinct
    model = quality.Follow(1 << bits, alpha=1.0, l1=3.0, l2=0.1)
    rows = [np.append(at[seen[at] >= least], 1 << bits) for at in parsed]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.update(rows[i], np.ones(len(rows[i])), y[i])
    return model.weights(slice(None)).astype(np.float32)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bits: int = 20, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    costs = language_model(lean(docs))
    weights = fit(docs, labels, costs, bits, **how)

    def score(text: pa.Array) -> pa.Array:
        decoder, out = Decoder(costs), [np.zeros(0)]
        for a, b in K.steps(text):
            got, at = presence(restored(text.slice(a, b - a), decoder), bits)
            s = K.sums(weights[got].astype(np.float64), at) + float(weights[-1])
            out.append(1 / (1 + np.exp(-np.clip(s, -35, 35))))
        return pa.array(np.concatenate(out))

    made = docs.select("doc_id", (~quality.in_training(F.col("doc_id"))).alias("held_out"), F.arrow_udf(score, "double")(F.col("text")).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
