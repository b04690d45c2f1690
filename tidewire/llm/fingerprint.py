"""Document fingerprints by a homomorphic multiset hash over paragraphs.

Each non-blank paragraph (line) is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo powers of two. So the order of
paragraphs doesn't matter, equal multisets have equal fingerprints, and a paragraph is
inserted or deleted by adding or subtracting its vector (``add``, ``subtract``). The vector has

* DENSE lanes modulo 2**64, each made from the paragraph's 128-bit BLAKE2b hash: these decide
  equality, and two paragraphs meet in all lanes only if their 128 bits do;
* LANES lanes modulo 2**32, to which each run of three words of the paragraph adds 1 or
  -1 in one lane (a count sketch): the cosine of two documents' lanes estimates how
  many word runs they share. It is cut to 0..1, and is 1 for equal fingerprints.

For ``edited`` texts each document meets the next one by doc_id. Ids are cut into ranges
at approximate quantiles, subdivided evenly; each range is sorted in one task and
streamed, and the first document of each range is sent to the range before it as well
(the first of all to the last). Texts are shuffled once.

A null text is empty: n_chars 0, fingerprint of no paragraphs. A null id comes first.
Ids are integers. Equal ids are ordered by text hash. A single document is its own next. Repeated rows
stand side by side. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.store import lean

DENSE, LANES = 32, 256
#: Quantiles at most, rows a range about, and parts of a quantile's range at most.
QUANTILES, RANGE_ROWS, PARTS = 1024, 200, 1024
_SALT = K.mix(np.arange(DENSE, dtype=K.U) + K.U(1 << 32))
_FIRST = -(1 << 63)


def _dense(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """Dense lanes: by text the sums of its paragraphs' lanes."""
    raw = data.tobytes()
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    low, high = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    with np.errstate(over="ignore"):
        return np.stack([K.sums(K.mix(K.mix(low + s) + high * (s | K.U(1))), of_text) for s in _SALT], axis=1)


def vectors(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Dense (uint64) and sketch (int32) lanes of each text."""
    dense, lanes = [np.zeros((0, DENSE), K.U)], [np.zeros((0, LANES), np.int32)]
    for a, b in K.steps(text):
        data, offsets = K.view(text.slice(a, b - a))
        ink = data != 10
        turn = np.ones(len(data), bool)
        turn[1:] = ink[1:] != ink[:-1]
        turn[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(turn)
        ends = np.append(starts[1:], len(data))
        starts, ends = (x[ink[starts]] for x in (starts, ends)) if len(data) else (starts[:0], ends[:0])
        of_text = np.searchsorted(starts, offsets)
        dense.append(_dense(data, starts, ends, of_text))
        first, last = K.spans(data, offsets)
        words = K.hashes(data, first, last)
        runs, at = K.shingles(words, np.append(np.searchsorted(first, starts), len(first)), 3)
        doc = np.repeat(np.repeat(np.arange(b - a), np.diff(of_text)), np.diff(at)) if len(starts) else np.zeros(0, np.int64)
        cell = doc * LANES + (runs >> K.U(56)).astype(np.int64)
        sign = np.where(runs & K.U(1), 1.0, -1.0)
        lanes.append(np.bincount(cell, sign, (b - a) * LANES).astype(np.int64).astype(np.int32).reshape(b - a, LANES))
    return np.concatenate(dense), np.concatenate(lanes)


def encoded(dense: np.ndarray, lanes: np.ndarray) -> list[str]:
    """Base64 of each row's little-endian lanes."""
    raw = np.concatenate([np.ascontiguousarray(dense.astype("<u8")).view(np.uint8).reshape(len(dense), -1), np.ascontiguousarray(lanes.astype("<i4")).view(np.uint8).reshape(len(lanes), -1)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in raw]


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * DENSE], "<u8"), np.frombuffer(raw[8 * DENSE :], "<i4")


def add(a: str, b: str) -> str:
    """Fingerprint of the two documents' paragraphs together."""
    with np.errstate(over="ignore"):
        (x, s), (y, t) = decoded(a), decoded(b)
        return encoded((x + y)[None], (s + t)[None])[0]


def subtract(a: str, b: str) -> str:
    """Fingerprint of the first document without the second's paragraphs."""
    with np.errstate(over="ignore"):
        (x, s), (y, t) = decoded(a), decoded(b)
        return encoded((x - y)[None], (s - t)[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row: 1 where fingerprints are equal, else the lanes' cosine, 0 at least."""
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    x, y = a[1].astype(float), b[1].astype(float)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return np.where(same, 1.0, np.clip((x * y).sum(axis=1) / np.maximum(norm, 1e-9), 0, 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint for every row of ``docs``."""

    def of(text: pa.Array) -> pa.Array:
        return pa.array(encoded(*vectors(text)), pa.string())

    return docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.arrow_udf(of, "string")(F.col("text")).alias("fingerprint"))


MADE = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in MADE.split(", ")]


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, tail, key, doc_id, text) in order of range: each but the tails with its successor."""
    held = None  # the last row so far: (b, tail, doc_id, text, dense, lanes)
    for batch in batches:
        columns = [batch.column(k) for k in (0, 1, 3)]
        for a, b in K.steps(batch.column(4)):
            own = K.plain(batch.column(4).slice(a, b - a)).fill_null("")
            dense, lanes = vectors(own)
            rows = list(zip(*(c.slice(a, b - a).to_pylist() for c in columns), own.to_pylist(), strict=True))
            if held:
                rows.insert(0, held[0])
                dense, lanes = np.concatenate([held[1], dense]), np.concatenate([held[2], lanes])
            held = (rows[-1], dense[-1:], lanes[-1:])
            at = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if not at:
                continue
            edited = []
            for i in at:
                text, k = rows[i][3], len(rows[i][3]) // 4
                edited.append(text[: len(text) - k] + rows[i + 1][3][:k])
            new = vectors(pa.array(edited, pa.large_string()))
            at = np.array(at)
            mine, following = (dense[at], lanes[at]), (dense[at + 1], lanes[at + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i][2] for i in at], pa.int64()), pa.array([len(rows[i][3]) for i in at], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                 pa.array(encoded(*mine)), pa.array(encoded(*new)), pa.array(likeness(mine, new)), pa.array(likeness(mine, following))], _NAMES)


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprint of every row of ``docs``, of its edited text, and their likeness and that to the next document."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    n = lean(docs).count()
    parts = max(1, min(QUANTILES, n // RANGE_ROWS))
    cuts = sorted({int(x) for x in docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 1 / (4 * parts))}) if parts > 1 else []
    finer = min(PARTS, n // (QUANTILES * 100 * RANGE_ROWS) + 1)
    if finer > 1:
        cuts = sorted({a + (b - a) * i // finer for a, b in zip(cuts, cuts[1:], strict=False) for i in range(finer)} | set(cuts))
    edges = np.array(cuts, np.int64)

    def of_range(k: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, k.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    # one row a range: at most QUANTILES * PARTS
    firsts = docs.select(key.alias("key")).groupBy(F.arrow_udf(of_range, "int")("key").alias("b")).agg(F.min("key").alias("first")).orderBy("b").collect()
    ids = np.array([r["first"] for r in firsts], np.int64)
    own = np.array([r["b"] for r in firsts], np.int32)

    def places(k: pa.Array) -> pa.Array:
        """The ranges that a row goes to: its own and, if it is first there, the one before."""
        k = k.to_numpy(zero_copy_only=False)
        b = np.searchsorted(edges, k, "right").astype(np.int32)
        at = np.searchsorted(own, b)
        out = [[{"b": int(x), "tail": False}, {"b": int(own[i - 1]), "tail": True}] if first else [{"b": int(x), "tail": False}] for x, i, first in zip(b, at, ids[at] == k, strict=True)]
        return pa.array(out, pa.list_(pa.struct([("b", pa.int32()), ("tail", pa.bool_())])))

    rows = docs.select(key.alias("key"), "doc_id", "text").select("key", F.col("doc_id").cast("long").alias("doc_id"), "text", F.explode(F.arrow_udf(places, "array<struct<b: int, tail: boolean>>")("key")).alias("p"))
    rows = rows.select("p.b", "p.tail", "key", "doc_id", "text").repartition("b").sortWithinPartitions("b", "tail", "key", F.xxhash64("text"))
    return rows.mapInArrow(walk, MADE)
