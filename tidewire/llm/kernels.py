"""Vectorised text kernels over Arrow string buffers.

Each works on whole texts. Batches are cut by bytes before numpy makes its
temporaries (eight bytes and more for each input byte), so memory is bounded by
``STEP`` or by one text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STEP = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LEN = 1 << 12
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(_LEN, 0x9E3779B97F4A7C15, U), dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: uint64 to uint64, each bit depends on every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def plain(column: pa.Array) -> pa.Array:
    """The column as one string array (no chunks, no views)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; a null is empty."""
    column = plain(column)
    if column.null_count:
        column = column.fill_null("")
    n, kind = len(column), np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``most`` bytes of text, or of one row."""
    _, offsets = view(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; none crosses a text's border."""
    ink = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = ink[edges]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = ink[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, ascending, non-empty byte ranges."""
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    total = int(size.sum())
    place = np.cumsum(size) - size
    rel = np.arange(total) - np.repeat(place, size)
    with np.errstate(over="ignore"):
        part = (data[rel + np.repeat(starts, size)].astype(U) + U(1)) * _POW[rel & (_LEN - 1)]
        # long ranges reuse the powers: their lap is mixed in
        if int(size.max()) > _LEN:
            part = np.where(rel >= _LEN, mix(part + U(0x5851F42D4C957F2D) * (rel >> 12).astype(U)), part)
        return mix(np.add.reduceat(part, place) + size.astype(U) * U(0xD6E8FEB86659FD93))


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and the place of each text's first (one more at the end)."""
    data, offsets = view(column)
    starts, ends = spans(data, offsets)
    h = hashes(LOWER[data] if lower else data, starts, ends)
    return h, np.searchsorted(starts, offsets)


_COEF = mix(np.arange(1, 65, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingles(h: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words, and the bounds by text. A text with fewer words, but one at least, has its whole sequence as one."""
    n = np.diff(bounds)
    with np.errstate(over="ignore"):
        count = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
        out = np.empty(int(count.sum()), U)
        at = np.concatenate([[0], np.cumsum(count)])
        full = n >= size
        if full.any():
            m = len(h) - size + 1
            runs = np.zeros(m, U)
            for k in range(size):
                runs += h[k : k + m] * _COEF[k]
            runs = mix(runs)
            c = count * full
            src = np.arange(int(c.sum())) + np.repeat(bounds[:-1] - (np.cumsum(c) - c), c)
            dst = np.arange(int(c.sum())) + np.repeat(at[:-1] - (np.cumsum(c) - c), c)
            out[dst] = runs[src]
        for i in np.flatnonzero((n > 0) & ~full):
            s = h[bounds[i] : bounds[i + 1]]
            out[at[i]] = mix((s * _COEF[: len(s)]).sum(dtype=U)[None] + U(len(s)) * _COEF[63])[0]
    return out, at


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (first axis) over each [bounds[i], bounds[i+1]); 0 where empty."""
    n = np.diff(bounds)
    out = np.zeros((len(n), *values.shape[1:]), values.dtype)
    if (full := n > 0).any():
        with np.errstate(over="ignore"):
            out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out
