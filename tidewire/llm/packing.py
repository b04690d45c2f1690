"""Packing documents into sequences of bounded length by minimum bin slack.

A document is its token ids and an end id. Longer documents are cut into pieces of the
full length, of which the first may be shorter; others stay whole. Bins are filled one
after another: the longest length that is left is taken first, then a subset-sum
programme over bitsets finds the combination of the other available lengths that fills
the bin most, and it is removed. The same combination is removed as often as the
stock of its lengths allows, which is what repeating the step would do: while it is
feasible, nothing fuller can be, for stocks only shrink. So the work depends on the
number of different lengths (at most ``length``), not on that of pieces: the driver
sees one histogram of at most ``length`` rows.

Pieces get their places by rank among the pieces of their length. Ranks come from
counts by (length, bucket of id hash) and row numbers within these. A length has a bucket for
each EACH of its pieces (more a bucket only beyond MOST buckets in all), so no length's
pieces meet in one task, even when a third of all have it.

A null or empty text is the end id alone (one piece of length 1). Equal lengths are
ordered by bucket, doc_id (null first), piece, checksum; repeated rows are packed as
often as they stand. Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.store import lean, settle

LENGTH, END = 1024, 2
#: Pieces of a bucket about, and buckets of all lengths about, at most.
EACH, MOST = 512, 1 << 20
#: Different parts of words whose ids a worker remembers.
MEMO = 250_000
#: Letters (two bytes at most) beside which the byte classes below agree with the tokenizer's; texts with other signs are split by the tokenizer itself.
_ODD = re.compile("[^\t-\r -~À-ÖØ-öø-ſ]")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Space 0, letter 1, digit 2, other 3.
_CLASS = np.where(K.SPACE, 0, np.where(_LETTER, 1, 3))
_CLASS[48:58] = 2
_CONTROL = re.compile("[\x1c-\x1f]")
_SHORT = re.compile(rb"'(?:[stmd]|re|ve|ll)")


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts that byte-level coding treats alone: runs of letters, of digits and of other signs, each with the one blank before it; white space; English short forms."""
    n = len(data)
    kind = _CLASS[data]
    turn = np.ones(n, bool)
    turn[1:] = kind[1:] != kind[:-1]
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    turn |= opens[:-1]
    s = np.flatnonzero(turn)
    e = np.append(s[1:], n)
    white = kind[s] == 0
    blank = np.zeros(len(s), bool)  # runs that take the blank before them
    if len(s) > 1:
        blank[1:] = white[:-1] & ~white[1:] & ~opens[s[1:]] & (data[s[1:] - 1] == 32)
    # white space before a word keeps its last sign apart: a blank joins the word
    inner = white & ~opens[e]
    first, last = [s[~white] - blank[~white]], [e[~white]]
    first += [s[white & ~inner], s[inner & (e - s > 1)], e[inner & (data[e - 1] != 32)] - 1]
    last += [e[white & ~inner], e[inner & (e - s > 1)] - 1, e[inner & (data[e - 1] != 32)]]
    first, last = np.concatenate(first), np.concatenate(last)
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    lone = np.flatnonzero((last - first == 1) & (data[first] == 39))
    if len(lone):
        drop, raw = [], data.tobytes()
        for i in lone:
            if i + 1 < len(first) and first[i + 1] == last[i] and not opens[last[i]] and (m := _SHORT.match(raw, first[i], last[i + 1])):
                last[i] = first[i + 1] = m.end()
                if first[i + 1] == last[i + 1]:
                    drop.append(i + 1)
        first, last = np.delete(first, drop), np.delete(last, drop)
    return first, last


def _signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it prints, else those from 256 on in turn."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Ids:
    """Token ids of whole texts by ``tokenizers``. The ids of parts of words are remembered by the parts' 64-bit hashes, so a part is encoded once a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        self.signs = _signs()
        self.clear()

    def clear(self) -> None:
        self.memo: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, key: int, part: bytes) -> int:
        ids = [x.id for x in self.coder.model.tokenize(part.decode("latin-1").translate(self.signs))]
        k = len(self.memo)
        if k == len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k], self.size[k] = self.used, len(ids)
        self.used += len(ids)
        self.memo[key] = k
        return k

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a small array."""
        values = text.fill_null("").to_pylist()
        odd = [i for i, x in enumerate(values) if not x.isascii() and _ODD.search(x) or _CONTROL.search(x)]
        data, offsets = K.view(text)
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(values)
        first, last = parts(data, offsets)
        seen, where, back = np.unique(K.hashes(data, first, last), return_index=True, return_inverse=True)
        if len(self.memo) > MEMO:
            self.clear()
        raw, memo = data.tobytes(), self.memo
        at = np.array([memo[h] if h in memo else self.learn(h, raw[first[i] : last[i]]) for h, i in zip(seen.tolist(), where.tolist(), strict=True)], np.int64)[back]
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.start[at] - (ends - size), size)]
        bounds = np.concatenate([[0], ends])[np.searchsorted(first, offsets)]
        out = [ids[bounds[i] : bounds[i + 1]] for i in range(len(values))]
        for i in odd:
            out[i] = self.encode(values[i])
        return out


@lru_cache(maxsize=1)
def coder(path: str) -> Ids:
    return Ids(path)


PIECES = "array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"
_PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first is shorter."""
    first = n if n <= length else n % length or length
    return [(0, first), *((a, length) for a in range(first, n, length))]


def pieces_of(path: str, length: int = LENGTH):
    """UDF: the pieces of a text."""

    def pieces(text: pa.Array) -> pa.Array:
        encode, out = coder(path), []
        for a, b in K.steps(text):
            for ids in encode(K.plain(text.slice(a, b - a))):
                data = ids.astype("<u4").tobytes() + END.to_bytes(4, "little")
                out.append([{"piece": k, "start": a, "length": m, "ids_crc32": zlib.crc32(data[4 * a : 4 * (a + m)])} for k, (a, m) in enumerate(cut(len(data) // 4, length))])
        return pa.array(out, _PIECES)

    return F.arrow_udf(pieces, PIECES)


def fullest(stock: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most ``room``; on ties the one with longer lengths.

    Counts are split into powers of two; ``reach`` holds which sums the parts so far make, one bit a sum.
    """
    parts, reach, mask = [], [1], (1 << (room + 1)) - 1
    for size in sorted(stock, reverse=True):
        if size > room:
            continue
        left, k = min(stock[size], room // size), 1
        while left > 0:
            k = min(k, left)
            more = reach[-1] | (reach[-1] << (k * size)) & mask
            if more != reach[-1]:
                parts.append((size, k))
                reach.append(more)
                if more >> room & 1:
                    break
            left -= k
            k *= 2
        if reach[-1] >> room & 1:
            break
    total, got = reach[-1].bit_length() - 1, {}
    for (size, k), before in zip(reversed(parts), reversed(reach[:-1]), strict=True):
        if not before >> total & 1:
            got[size] = got.get(size, 0) + k
            total -= k * size
    return got


def fill(stock: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(piece length, how many)]) for each kind of bin, longest piece first; together they use up ``stock``."""
    stock, bins = {k: v for k, v in stock.items() if v > 0}, []
    while stock:
        top = max(stock)
        stock[top] -= 1
        rest = fullest({k: v for k, v in stock.items() if v > 0}, length - top)
        stock[top] += 1
        kind = {top: 1}
        for k, v in rest.items():
            kind[k] = kind.get(k, 0) + v
        times = min(stock[k] // v for k, v in kind.items())
        for k, v in kind.items():
            stock[k] -= times * v
            if not stock[k]:
                del stock[k]
        bins.append((times, sorted(kind.items(), reverse=True)))
    return bins


def placed(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length its rows (first rank, first sequence, uses in one bin, offset of the first) in order of rank."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for times, kind in bins:
        offset = 0
        for size, n in kind:
            rows.setdefault(size, []).append((used.get(size, 0), sequence, n, offset))
            used[size] = used.get(size, 0) + times * n
            offset += size * n
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``. tokenizer: path of a file for ``tokenizers``, on every machine."""
    cells = lean(docs).select("doc_id", F.explode(pieces_of(tokenizer, length)(F.col("text"))).alias("p")).select("doc_id", "p.*")
    cells = settle(cells.withColumn("hash", F.xxhash64("doc_id", "piece", "ids_crc32")))
    stock = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    each = max(EACH, sum(stock.values()) // MOST)
    many = docs.sparkSession.createDataFrame([(k, 1 + n // each) for k, n in stock.items()], "length long, many int")
    cells = cells.join(F.broadcast(many), "length").withColumn("bucket", F.expr("int(pmod(hash, many))")).drop("hash", "many")
    counts = cells.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = settle(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    table = placed(fill(stock, length))

    def place(size: pa.Array, rank: pa.Array) -> pa.Array:
        size, rank = size.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if len(own):
                rows, k = table[int(size[own[0]])], rank[own]
                at = np.searchsorted(rows[:, 0], k, "right") - 1
                into, n = k - rows[at, 0], rows[at, 2]
                sequence[own] = rows[at, 1] + into // n
                offset[own] = rows[at, 3] + into % n * size[own]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    # at most MOST + length counts
    ranked = cells.join(F.broadcast(counts.select("length", "bucket", "before")), ["length", "bucket"])
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = ranked.withColumn("rank", F.col("before") + within - 1)
    made = ranked.withColumn("at", F.arrow_udf(place, "struct<sequence_id: bigint, offset: bigint>")("length", "rank"))
    return made.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
