"""Chroma fingerprints of media columns, and alignment of recordings by them.

Samples are cut into overlapping frames; the power between two frequencies goes to one of
twelve pitch classes. Over the picture of pitch classes by time, an integral image
gives the sum of any rectangle from four values; sixteen filters compare rectangles
within a window of frames, and each comparison becomes two bits (Gray code), so a
window is one packed 32-bit integer. Windows follow each other by one frame.

Two recordings are aligned where their offset histogram is highest, over windows whose integers
agree in either half (the best of the PEAKS highest places, by bit error); there, the share
of bits that differ in the overlap is the bit error. They are linked if the overlap is at least
OVERLAP of the shorter one and the bit error at most ERROR.

Candidates share a landmark: a key whose hash is least among ``span`` successive ones. Keys
are whole integers, and halves of an integer with the same half WINDOW later, which
live through noise in the other half. Candidates, checks and components: see
links.py. Equal fingerprints are one item. Landmarks are an index: the README states their recall.

A recording is a WAV file (PCM of 8 or 16 bits, any channels and rate: channels are averaged, rates
converted by linear interpolation), or else 8-bit unsigned mono samples at the shape's rate.
Files of other formats, nulls and empty recordings have no fingerprint and no class of
others: class_id is their own id, n_codes 0. ``shape`` sets rate, frame and step: AUDIO is for
sound; the query takes the bytes of texts as samples, and TEXT, whose frames are short.
Shorter recordings than one window are padded with silence. Rows with a null id have a null
class. Repeated rows have equal fingerprints and so one class.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.links import star_components
from tidewire.llm.store import lean, settle

WINDOW, OVERLAP, ERROR, PEAKS = 16, 0.5, 0.1, 3
#: Samples whose frames are computed together.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Shape:
    """Samples a second, samples of a frame and between frames, the frequencies that count, successive keys of which one is a landmark, and the difference (of logarithms) from which one side of a filter is well above the other."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    low: float = 60.0
    high: float = 3520.0
    span: int = 8
    level: float = 0.25

    def fold(self) -> np.ndarray:
        """Which pitch class each frequency of a frame's spectrum belongs to (rows: frequencies)."""
        freq = np.arange(self.frame // 2 + 1) * self.rate / self.frame
        heard = np.flatnonzero((freq >= self.low) & (freq <= self.high))
        out = np.zeros((len(freq), 12), np.float32)
        out[heard, np.rint(12 * np.log2(freq[heard] / 440)).astype(int) % 12] = 1
        return out


AUDIO = Shape()
#: 8 Hz between frequencies: neighbouring semitones are apart from 140 Hz on. The spectrum of texts is even, so small differences count.
TEXT = Shape(rate=2048, frame=256, hop=64, low=120.0, high=1000.0, level=0.1)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) by rule: every kind in turn, with heights and widths that grow.

    Kinds: 0 the first against the second half of the frames, 1 the lower against the
    upper classes, 2 the middle third of the frames against the rest, 3 the diagonal quarters.
    """
    return [(k % 4, 3 * k % 7, (2, 4, 6)[k % 3] if k % 4 != 1 else 6, (8, 12, 15, 16)[k // 4]) for k in range(16)]


def _packed(chroma: np.ndarray, starts: np.ndarray, mid: float = 0.25) -> np.ndarray:
    """The integer of the window at each of ``starts`` (frames)."""
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)

    def box(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        column = image[:, y1] - image[:, y0]
        return column[starts + t1] - column[starts + t0]

    packed = np.zeros(len(starts), np.uint32)
    for kind, y, h, w in filters():
        y = min(y, 12 - h)
        if kind == 0:
            p, q = box(0, w // 2, y, y + h), box(w // 2, w // 2 * 2, y, y + h)
        elif kind == 1:
            p, q = box(0, w, y, y + h // 2), box(0, w, y + h // 2, y + h)
        elif kind == 2:
            t = w // 3
            p, q = 2 * box(t, 2 * t, y, y + h), box(0, t, y, y + h) + box(2 * t, 3 * t, y, y + h)
        else:
            p = box(0, w // 2, y, y + h // 2) + box(w // 2, w // 2 * 2, y + h // 2, y + h)
            q = box(0, w // 2, y + h // 2, y + h) + box(w // 2, w // 2 * 2, y, y + h // 2)
        d = np.log((p + 0.05) / (q + 0.05))
        level = (d > -mid).astype(np.uint32) + (d > 0) + (d > mid)
        packed = packed << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)
    return packed


def codes(recordings: list[np.ndarray], shape: Shape = AUDIO) -> list[np.ndarray]:
    """The packed integers (uint32) of each recording (samples around 0). Frames of all are computed together, a block at a time."""
    frame, hop = shape.frame, shape.hop
    size = np.array([len(x) for x in recordings], np.int64)
    long = np.where(size > 0, np.maximum(size, frame + (WINDOW - 1) * hop), 0)
    begin = np.cumsum(long) - long
    x = np.zeros(int(long.sum()), np.float32)
    for a, r in zip(begin, recordings, strict=True):
        x[a : a + len(r)] = r
    n = np.where(size > 0, (long - frame) // hop + 1, 0)
    total, first = int(n.sum()), np.cumsum(n) - n
    at = np.repeat(begin - first * hop, n) + np.arange(total) * hop  # first sample of each frame
    chroma, bell, fold, many = np.empty((total, 12), np.float32), np.hanning(frame).astype(np.float32), shape.fold(), max(1, BLOCK // frame)
    for a in range(0, total, many):
        part = np.lib.stride_tricks.sliding_window_view(x, frame)[at[a : a + many]]
        power = np.abs(np.fft.rfft(part * bell, axis=1)).astype(np.float32)
        folded = (power * power) @ fold
        chroma[a : a + many] = folded / np.maximum(folded.sum(axis=1, keepdims=True), 1e-6)
    m = np.maximum(n - WINDOW + 1, 0)
    out = []
    ends = np.cumsum(m)
    starts = np.repeat(first - (ends - m), m) + np.arange(int(m.sum()))
    # sums run within groups of recordings, so that their rounding stays small beside a window
    a = 0
    while a < len(recordings):
        b = max(a + 1, int(np.searchsorted(first + n, first[a] + (1 << 14), "right")))
        own = starts[ends[a] - m[a] : ends[b - 1]] - first[a]
        packed = _packed(np.round(chroma[first[a] : first[b - 1] + n[b - 1]].astype(float), 6), own, shape.level)
        out += np.split(packed, (ends[a:b] - (ends[a] - m[a]))[:-1])
        a = b
    return out


def samples(payload: bytes | None, rate: int) -> np.ndarray:
    """Samples around 0 (float32) of a WAV file's payload, or of bare 8-bit samples; none of what can't be read."""
    none = np.zeros(0, np.float32)
    if not payload:
        return none
    if payload[:4] != b"RIFF" or payload[8:12] != b"WAVE":
        return np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    at, form, data = 12, None, None
    while at + 8 <= len(payload):
        name, size = payload[at : at + 4], int.from_bytes(payload[at + 4 : at + 8], "little")
        if name == b"fmt " and size >= 16 and at + 24 <= len(payload):
            form = struct.unpack("<HHIIHH", payload[at + 8 : at + 24])
        elif name == b"data":
            data = payload[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None or form[0] != 1 or form[1] < 1 or form[2] < 1 or form[5] not in (8, 16):
        return none
    _, channels, own, _, _, bits = form
    x = np.frombuffer(data[: len(data) // (channels * bits // 8) * (channels * bits // 8)], np.uint8 if bits == 8 else "<i2").astype(np.float32)
    x = (x - 128 if bits == 8 else x / 256).reshape(-1, channels).mean(axis=1)
    return x if own == rate or not len(x) else np.interp(np.arange(0, len(x), own / rate), np.arange(len(x)), x).astype(np.float32)


def _keys(own: np.ndarray) -> list[np.ndarray]:
    """Whole integers, and each half with the same half WINDOW later."""
    out = [own.astype(K.U)]
    for half in (own >> np.uint32(16), own & np.uint32(0xFFFF)):
        h = half.astype(K.U)
        out.append(h[:-WINDOW] << K.U(16) | h[WINDOW:])
    return out


def landmarks(own: np.ndarray, span: int = 8) -> np.ndarray:
    """Distinct hashes (int64) of the keys that are least among ``span`` successive ones (fewer in short recordings); of all, if there are fewer."""
    found, span = [np.zeros(0, K.U)], min(span, max(2, len(own) // 12))
    for kind, key in enumerate(_keys(own)):
        h = K.mix(key + (K.U(kind + 1) << K.U(33)))
        if len(h) >= span:
            found.append(np.lib.stride_tricks.sliding_window_view(h, span).min(axis=1))
        elif len(h):
            found.append(h.min(keepdims=True))
    return np.unique(np.concatenate(found)).view(np.int64)


def _votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shifts for which values of ``b`` vote: a value's first place in ``a`` less each place in ``b``."""
    seen, first = np.unique(a, return_index=True)
    at = np.minimum(np.searchsorted(seen, b), len(seen) - 1)
    hit = seen[at] == b
    return first[at[hit]] - np.flatnonzero(hit)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(offset, overlap, differing bits): window i of ``b`` lies at window i + offset of ``a``. Of the PEAKS shifts with most votes (ties: the smallest) the one of least bit error that overlaps enough, else the first."""
    low = np.uint32(0xFFFF)
    votes = np.concatenate([_votes(a >> np.uint32(16), b >> np.uint32(16)), _votes(a & low, b & low)])
    if not len(votes):
        return 0, 0, 0
    shifts, n = np.unique(votes, return_counts=True)
    best = None
    for k in np.lexsort((shifts, np.abs(shifts), -n))[:PEAKS]:
        offset = int(shifts[k])
        first, last = max(0, offset), min(len(a), len(b) + offset)
        bits = int(np.bitwise_count(a[first:last] ^ b[first - offset : last - offset]).sum())
        found = (last - first < OVERLAP * min(len(a), len(b)), bits / (last - first))
        if best is None or found < best[0]:
            best = found, (offset, last - first, bits)
    return best[1]


def linked(n: int, m: int, overlap: int, bits: int) -> bool:
    return overlap > 0 and overlap >= OVERLAP * min(n, m) and bits <= ERROR * 32 * overlap


PRINT = "struct<n_codes: bigint, crc: bigint, k: bigint, codes: binary>"
_PRINT = pa.struct([("n_codes", pa.int64()), ("crc", pa.int64()), ("k", pa.int64()), ("codes", pa.binary())])


def fingerprinted(shape: Shape):
    """UDF: fingerprint of a recording."""

    def of(media: pa.Array) -> pa.Array:
        out, todo, size = [], [], 0
        for i in range(len(media) + 1):
            if i == len(media) or size > K.STEP:
                for own in codes(todo, shape):
                    raw = own.astype("<u4").tobytes()
                    with np.errstate(over="ignore"):
                        k = int(K.mix(own.astype(K.U) + np.arange(len(own), dtype=K.U) * K._COEF[20]).sum(dtype=K.U).astype(np.int64))
                    out.append({"n_codes": len(own), "crc": zlib.crc32(raw), "k": k, "codes": raw})
                todo, size = [], 0
            if i < len(media):
                todo.append(samples(media[i].as_py(), shape.rate))
                size += len(todo[-1])
        return pa.array(out, _PRINT)

    return F.arrow_udf(of, PRINT)


def marks_of(span: int):
    """UDF: landmarks of packed integers."""

    def of(own: pa.Array) -> pa.Array:
        return pa.array([landmarks(np.frombuffer(x.as_buffer(), "<u4"), span) for x in own], pa.list_(pa.int64()))

    return F.arrow_udf(of, "array<bigint>")


def _check(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
        _, overlap, bits = align(x, y)
        out.append(linked(len(x), len(y), overlap, bits))
    return pa.array(out, pa.bool_())


def _measure(a: pa.Array, b: pa.Array) -> pa.Array:
    """Offset and bit error of the second recording against the first."""
    out = []
    for x, y in zip(a, b, strict=True):
        offset, overlap, bits = align(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"))
        out.append({"shift": offset, "bit_error": bits / (32 * overlap) if overlap else None})
    return pa.array(out, pa.struct([("shift", pa.int64()), ("bit_error", pa.float64())]))


def recordings(media: DataFrame, shape: Shape = AUDIO) -> DataFrame:
    """doc_id, n_codes, codes_crc32, class_id, shift, bit_error for every row of ``media`` (doc_id, samples binary).

    class_id: the smallest id that links reach. shift and bit_error: alignment with that
    recording (in windows); null where no integers agree in a half.
    """
    lean(media)
    # the one table that holds codes: the others have ids
    rows = settle(media.select("doc_id", fingerprinted(shape)(F.col("samples")).alias("f")).select("doc_id", "f.*"))
    key = ["k", "crc", "n_codes"]
    full = rows.where("n_codes > 0 AND doc_id IS NOT NULL")
    items = settle(full.groupBy(*key).agg(F.min("doc_id").alias("id")))
    # an id whose rows differ has one recording that speaks for it
    names = items.groupBy("id").agg(F.min_by(F.struct(*key), "k").alias("p")).select("id", "p.*")
    own = full.join(names.select(F.col("id").alias("doc_id"), *key), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), F.col("n_codes").alias("n"), "codes")
    buckets = own.select(F.explode(marks_of(shape.span)("codes")).alias("bucket"), "id", "n")

    def some(ids: DataFrame) -> DataFrame:
        return own.join(ids, "id", "left_semi").select("id", F.col("codes").alias("own"))

    comp = star_components(buckets, some, _check, keep=False)
    member = comp.where("id <> comp").select(F.col("comp").alias("u"), F.col("id").alias("v"))
    u, v = (own.select(F.col("id").alias(k), F.col("codes").alias(f"codes_{k}")) for k in "uv")
    aligned = member.join(u, "u").join(v, "v").select("u", "v", F.arrow_udf(_measure, "struct<shift: bigint, bit_error: double>")("codes_u", "codes_v").alias("m"))
    named = items.join(aligned, F.col("id") == F.col("v"), "left").select(*key, F.coalesce("u", "id").alias("class_id"), F.when(F.col("v").isNull(), 0).otherwise(F.col("m.shift")).alias("shift"), F.when(F.col("v").isNull(), 0.0).otherwise(F.col("m.bit_error")).alias("bit_error"))
    made = full.join(named, key).select("doc_id", "n_codes", F.col("crc").alias("codes_crc32"), "class_id", "shift", "bit_error")
    alone = rows.where("n_codes = 0 OR doc_id IS NULL").select("doc_id", "n_codes", F.col("crc").alias("codes_crc32"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("shift"), F.lit(0.0).alias("bit_error"))
    return made.union(alone)
