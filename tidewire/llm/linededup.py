"""Line dedup by pairwise alignment: blocks of lines that a later document shares with an earlier one go from the later.

Documents are ordered by doc_id. Lines are compared by their words; blanks between and
around don't count, and lines without words are passed over. A block is a run of
successive lines of at least WORDS words, or of at least LINES lines and LEAST words: a
single short line is no block, however many documents have it.

Candidates: from each line a run goes on, forwards and backwards, until it is a
block. Such a run's hash is rare: few documents hold it, unless they share the block. Each later
holder of a run is paired with its first one (star-shaped: n holders make n - 1 pairs, however many they are). Every line of a
shared block is in a run within that block, whose first holder is an earlier document, so each shared block is found.

Each pair is aligned once by patience diff: lines that stand once in both are matched along a longest increasing
run, matches grow over equal neighbours, and the gaps between are treated alike. Aligned
runs that are blocks are deleted from the later document. What the diff leaves out, since it is in another order,
repeated, or made of lines that repeat, is aligned by the runs themselves: each run that brought the pair about is looked up in the
earlier document and deleted where it stands there. So a line goes if, and only if, it is in a block that an earlier document holds too.

Runs with over 1/4096 of all holders (4,096 at most) are joined by broadcast, so no key gathers in one task; a first
holder that very many are paired with is a hot key of one join, whose other side has one row for it: adaptive execution splits it.

Line hashes (64 bits, the last six a count of words), not texts, are joined; texts move
once, to have lines taken out. Python gets batches of bounded bytes (store.lean) or one pair.

Null texts stay null, empty ones empty; both, and rows with a null doc_id, change and
are changed by nothing. Rows that repeat a doc_id aren't compared with each other;
each is compared with other documents. A document all of whose lines go has an empty text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.store import Shelf, lean

WORDS, LINES, LEAST = 20, 2, 10
#: A run with this part of all holders is joined by broadcast.
HEAVY = 4096
#: The bits of a line's hash that count its words, up to this number.
MANY = 63


def line_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (uint64) and number of words of each line, and the bounds by text."""
    data, offsets = K.view(column)
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks]), kind="stable")
    edges = np.append(starts, offsets[-1])
    first, last = K.spans(data, offsets)
    h = K.hashes(data, first, last)
    at = np.searchsorted(first, edges)
    rel = (np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))).astype(K.U)
    with np.errstate(over="ignore"):
        lines = K.sums(K.mix(h + rel * K._COEF[30]), at)
    # a text of n breaks has n + 1 lines: its own start, and one after each break
    own = 1 + np.searchsorted(breaks, offsets[1:], "right") - np.searchsorted(breaks, offsets[:-1], "right")
    size = np.diff(at)
    return lines & ~K.U(MANY) | np.minimum(size, MANY).astype(K.U), size, np.concatenate([[0], np.cumsum(own)])


def is_block(words: int, lines: int) -> bool:
    return words >= WORDS or lines >= LINES and words >= LEAST


_STEP = K._COEF[33]
_BACK = K.U(pow(int(_STEP), -1, 1 << 64))


def runs(lines: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first line, last line) of the least runs that are blocks, from each line of each text forwards and backwards."""
    at = np.flatnonzero(lines & K.U(MANY))  # lines without words are passed over
    text = np.searchsorted(bounds, at, "right") - 1
    n, h = len(at), lines[at]
    total = np.concatenate([[0], np.cumsum((h & K.U(MANY)).astype(np.int64))])
    i = np.arange(n)
    start, end = np.searchsorted(text, text, "left"), np.searchsorted(text, text, "right")
    # the least j with enough words in [i, j], and likewise backwards
    ahead = np.minimum(np.searchsorted(total, total[:-1] + WORDS) - 1, np.maximum(i + LINES - 1, np.searchsorted(total, total[:-1] + LEAST) - 1))
    back = np.maximum(np.searchsorted(total, total[1:] - WORDS, "right") - 1, np.minimum(i - LINES + 1, np.searchsorted(total, total[1:] - LEAST, "right") - 1))
    first = np.concatenate([i[ahead < end], back[back >= start]])
    last = np.concatenate([ahead[ahead < end], i[back >= start]])
    cells = np.unique(first * (n + 1) + last)
    first, last = cells // (n + 1), cells % (n + 1)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[K.U(1)], np.full(n, _STEP, K.U)]), dtype=K.U)
        shift = np.cumprod(np.concatenate([[K.U(1)], np.full(n, _BACK, K.U)]), dtype=K.U)
        sums = np.concatenate([[K.U(0)], np.cumsum(K.mix(h) * power[:n], dtype=K.U)])
        run = K.mix((sums[last + 1] - sums[first]) * shift[first] + (last - first).astype(K.U))
    return text[first], run.view(np.int64), at[first] - bounds[text[first]], at[last] - bounds[text[first]]


def outline(text: pa.Array) -> pa.Array:
    """Each text's lines (packed hashes) and its runs."""
    packed, cells, count = [], [], [np.zeros(1, np.int64)]
    for a, b in K.steps(text):
        lines, _, bounds = line_hashes(text.slice(a, b - a))
        packed += [lines[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)]
        of, *found = runs(lines, bounds)
        cells.append(found)
        count.append(np.bincount(of, minlength=b - a))
    run, first, last = (np.concatenate([c[k] for c in cells]) if cells else np.zeros(0, np.int64) for k in range(3))
    rows = pa.StructArray.from_arrays([pa.array(run), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["run", "a", "b"])
    at = pa.array(np.cumsum(np.concatenate(count)).astype(np.int32))
    return pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.ListArray.from_arrays(at, rows)], ["lines", "runs"])


def rising(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct values."""
    tails, at, before = [], [], [0] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places that patience diff aligns, ascending in both. A gap without lines that stand once in both is left, but for equal lines at its ends."""
    got, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            got.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            got.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 == in_b[x]}
        mine = [(j, place[x]) for j, x in enumerate(b[b0:b1], b0) if x in place]
        if not mine:
            continue
        chain = [mine[k] for k in rising([i for _, i in mine])]
        pi, pj = a0, b0
        for j, i in [*chain, (b1, a1)]:
            todo.append((pi, i, pj, j))
            if i < a1:
                got.append((i, j))
            pi, pj = i + 1, j + 1
    return sorted(got)


def blocks(pairs: list[tuple[int, int]], words: list[int]) -> list[tuple[int, int, int]]:
    """(first place in a, first place in b, length) of the aligned runs that are blocks. words: of the lines of b."""
    out, k = [], 0
    while k < len(pairs):
        n = 1
        while k + n < len(pairs) and pairs[k + n] == (pairs[k][0] + n, pairs[k][1] + n):
            n += 1
        if is_block(sum(words[pairs[k][1] : pairs[k][1] + n]), n):
            out.append((*pairs[k], n))
        k += n
    return out


def aligned(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Ranges (first line, last line) of ``b`` that are aligned with lines of ``a``, as packed hashes. anchors: ranges of ``b`` to look up in ``a`` where the diff leaves them out."""
    at_a, at_b = np.flatnonzero(a & K.U(MANY)), np.flatnonzero(b & K.U(MANY))
    x, y = a[at_a], b[at_b]
    words = (y & K.U(MANY)).tolist()
    if len(x) == len(y) and (x == y).all():
        return [(int(at_b[0]), int(at_b[-1]))] if len(y) and is_block(sum(words), len(y)) else []
    # lines that only one has match nothing; blocks are told by their places among all
    of_x, of_y = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    pairs = [(int(of_x[i]), int(of_y[j])) for i, j in patience(x[of_x].tolist(), y[of_y].tolist())]
    found = [(int(at_b[j]), int(at_b[j + n - 1])) for _, j, n in blocks(pairs, words)]
    gone = np.zeros(len(b) + 1, np.int64)
    for first, last in found:
        gone[first] += 1
        gone[last + 1] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(gone[:-1]) > 0)])
    earlier, known = x.tobytes(), {}
    for first, last in anchors:
        if covered[last + 1] - covered[first] == last + 1 - first:
            continue
        run = y[np.searchsorted(at_b, first) : np.searchsorted(at_b, last, "right")].tobytes()
        if run not in known:
            place = earlier.find(run)
            while place % 8 and place >= 0:
                place = earlier.find(run, place + 1)
            known[run] = place >= 0
        if known[run]:
            found.append((first, last))
    return sorted(found)


def common(mine: pa.Array, theirs: pa.Array, runs: pa.Array) -> pa.Array:
    """Ranges of lines of the later document that are aligned with the earlier one, as first and last in turn. runs: what both hold, likewise."""
    out = []
    for b, a, r in zip(mine, theirs, runs, strict=True):
        r = r.values.to_numpy()
        ranges = aligned(np.frombuffer(a.as_buffer(), K.U), np.frombuffer(b.as_buffer(), K.U), list(zip(r[::2].tolist(), r[1::2].tolist(), strict=True)))
        out.append([x for r in ranges for x in r])
    return pa.array(out, pa.list_(pa.int32()))


def repeated_lines(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc_id, fp, gone): by document the places, from 0, of the lines to delete. fp: hash of the text."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    made = F.arrow_udf(outline, "struct<lines: binary, runs: array<struct<run: bigint, a: int, b: int>>>")(F.col("text"))
    slim = shelf.put(rows.select("doc_id", F.xxhash64("text").alias("fp"), made.alias("o")).select("doc_id", "fp", "o.*").where("size(runs) > 0"))
    held = slim.select("doc_id", "fp", F.explode("runs").alias("r")).select("doc_id", "fp", "r.*")
    # n: rows, so of a run that stands twice in a document both
    first = shelf.put(held.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("run", "first", "n"))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = docs.sparkSession.createDataFrame(first.where(F.col("n") >= max(2.0, total / HEAVY)).collect(), first.schema)  # HEAVY rows at most
    large = held.join(F.broadcast(few), "run")
    small = held.join(F.broadcast(few.select("run")), "run", "left_anti").join(first, "run")
    later = shelf.put(large.unionByName(small).where("doc_id > first"))
    pairs = later.groupBy("doc_id", "fp", "first").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("runs"))
    # an id's rows with equal texts are one document here
    one = slim.select("doc_id", "fp", "lines").dropDuplicates(["doc_id", "fp"])
    theirs = one.select(F.col("doc_id").alias("first"), F.col("lines").alias("theirs"))
    both = pairs.join(one.withColumnRenamed("lines", "mine"), ["doc_id", "fp"]).join(theirs, "first")
    found = both.select("doc_id", "fp", F.arrow_udf(common, "array<int>")("mine", "theirs", "runs").alias("ranges")).where("size(ranges) > 0")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size("ranges") - 2, F.lit(2)), lambda i: F.sequence(F.get("ranges", i), F.get("ranges", i + 1))))
    gone = found.groupBy("doc_id", "fp").agg(F.array_distinct(F.flatten(F.collect_set(spans))).alias("gone"))
    return shelf.keep_only(shelf.put(gone))


def _cleaned(docs: DataFrame) -> DataFrame:
    """(row, n_lines, n_removed, cleaned) for every row."""
    gone = repeated_lines(lean(docs), Shelf(docs.sparkSession)).select(F.xxhash64("doc_id", "fp").alias("key_"), F.col("doc_id").alias("id_"), F.col("fp").alias("fp_"), "gone")
    # rows without an id are spread by their texts
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key"), F.xxhash64("text").alias("fp"))
    # one plan at every size: what goes grows with the corpus
    joined = rows.join(gone.hint("merge"), (F.col("key") == F.col("key_")) & (F.col("row.doc_id") == F.col("id_")) & (F.col("fp") == F.col("fp_")), "left")
    lines = F.split("row.text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    cleaned = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col("row.text").isNotNull(), F.size(lines)).otherwise(0)
    return joined.select("row", count.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), cleaned.alias("cleaned"))


def clean(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text (without the deleted lines) for every row of ``docs``."""
    return _cleaned(docs).select("row.doc_id", "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"), F.col("cleaned").alias("text"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with lines deleted from ``text`` (and ``n_chars`` counted anew); rows of whose lines only such without words are left go."""
    made = _cleaned(docs).where(r"NOT (n_removed > 0 AND cleaned RLIKE '^[\\x20\\x09-\\x0D]*$')")
    new = {"text": F.col("cleaned"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("cleaned").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return made.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))
