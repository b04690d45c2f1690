r"""Source divergence audit by sort-based streaming: how far apart the sources of a language are in their use of terms.

Terms are the runs ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` (ASCII letters and all that is not ASCII) of whole texts, A-Z
lowered. A language keeps the V terms that stand in at least LEAST of its documents. A source's p of a
kept term is 1 + floor(UNIT * (count + ADD) / (N + ADD * V)), N its count of kept terms. Two sources differ by the sum of abs(p - p')
over all kept terms (part ``pair``); a term marks a source by p - q, q of the language, where it is used and p > q
(part ``term``, the first TOP). All numbers are exact: decimals of 38 digits where longs could overflow.

Method. A task counts terms by language and source, documents and occurrences, and lets go of what it holds at HOLD entries: a record
(lang, term, source, document, docs, n), named by the first of its documents. So a term that all documents have is no hot key: it has a record for each
source and HOLD entries of a task, however many documents there are. Records are repartitioned by language and term, and sorted within partitions by term,
language, source and document (the term first: its bytes decide most comparisons). A scan over a sorted partition sees each
(lang, term, source) as one run, sums its documents and occurrences, and at a term's end lets the runs of kept terms out: nothing else is shuffled again.
Kept terms (lang, term, source, p) are few beside the corpus; they are sorted by (lang, term, source) and scanned again: for a term that k sources use, the task
adds what each pair of them shares to sums by pair, which it emits (FLUSH pairs at a time at most), and each source's best terms to a list of TOP.

Nothing is made dense. With p0 a source's p of a term that it doesn't use (larger than 0), the sum over terms of abs(p_a - p_b) is

    V |p0_a - p0_b| + A(a, b) + A(b, a) + C(a, b),

A(a, b) the sum over a's terms of |p_a - p0_b| - |p0_a - p0_b|, from running sums over a's distinct p, and C(a, b) the sum over shared
terms of |p_a - p_b| - |p_a - p0_b| - |p0_a - p_b| + |p0_a - p0_b|, from the scan. Rows are then the pairs asked for, and the kept terms.

Null text, lang and source are ''. Every row is a document, so rows that repeat a doc_id count again, and null ids count. A group
without kept terms is compared all the same (its p are all p0); where a language keeps no term (V = 0) values are 0. Extra columns are ignored.
An empty table gives no rows. Ties go by the UTF-8 bytes of the item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.store import Shelf, lean

LEAST, UNIT, ADD, TOP = 30, 1_000_000_000, 5, 50
#: Entries that a counting task holds, and pairs whose sums a scan holds, before they are emitted.
HOLD, FLUSH = 1 << 18, 1 << 18

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
for _a in (65, 97):
    _LETTERS[_a : _a + 26] = np.arange(97, 123)
#: Bytes of terms as they are, A-Z lowered; all others blank.
LETTERS = _LETTERS.tobytes()
RECORDS = "lang string, term string, source string, doc int, docs long, n long"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over documents (lang, source, doc, text): RECORDS, summed as far as HOLD entries reach."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size, first = 0, None

    def records() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, n) in held.items():
            k = len(n)
            same = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(k, np.int64)))
            term = pa.array(n.keys(), pa.binary()).cast(pa.string())
            if k:
                yield pa.RecordBatch.from_arrays([same(lang, pa.string()), term, same(source, pa.string()), same(first, pa.int32()), pa.array([docs[t] for t in n], pa.int64()), pa.array(n.values(), pa.int64())], ["lang", "term", "source", "doc", "docs", "n"])

    for b in batches:
        data, at = K.view(b["text"])
        for i, (lang, source, doc) in enumerate(zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["doc"].to_pylist(), strict=True)):
            words = data[at[i] : at[i + 1]].tobytes().translate(LETTERS).split(b" ")
            docs, n = held.setdefault((lang, source), (Counter(), Counter()))
            before, first = len(n), doc if first is None else first
            own = set(words) - {b""}
            n.update(w for w in words if w) if b"" in words else n.update(words)
            docs.update(own)
            size += len(n) - before
            if size >= HOLD:
                yield from records()
                held, size, first = {}, 0, None
    yield from records()


def _starts(*columns: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before in any column (the first always does)."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return new


KEPT = "lang string, term string, source string, n long, all_n long"


def run_lengths(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function over records (lang, term, source, docs, n), all of a term in one partition and sorted by term, language and source: the runs (KEPT) of terms in ``least`` documents, with their sums."""
    names = ["lang", "term", "source", "docs", "n"]

    def runs(b: pa.RecordBatch) -> pa.RecordBatch:
        """Equal (lang, term, source) summed."""
        first = np.flatnonzero(_starts(b["term"], b["lang"], b["source"]))
        at = pa.array(first)
        return pa.RecordBatch.from_arrays([*(b[k].take(at) for k in names[:3]), *(pa.array(np.add.reduceat(b[k].to_numpy(), first)) for k in names[3:])], names)

    def kept(b: pa.RecordBatch) -> pa.RecordBatch:
        """The runs of whole terms that have enough documents."""
        first = np.flatnonzero(_starts(b["term"], b["lang"]))
        size = np.diff(np.append(first, b.num_rows))
        docs, n = (np.add.reduceat(b[k].to_numpy(), first) for k in ("docs", "n"))
        some = pa.array(np.repeat(docs >= least, size))
        return pa.RecordBatch.from_arrays([*(b[k].filter(some) for k in names[:3]), b["n"].filter(some), pa.array(np.repeat(n, size)).filter(some)], [*names[:3], "n", "all_n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # the runs of the last term, which the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            b = b.select(names)
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            b = runs(b)
            cut = int(np.flatnonzero(_starts(b["term"], b["lang"]))[-1])
            rest = b.slice(cut)
            if cut:
                yield kept(b.slice(0, cut))
        if rest is not None:
            yield kept(rest)

    return scan


SCANNED = "lang string, part string, source string, item string, value long"


class _Sums:
    """Sums by pair of sources of a language, emitted when many are held."""

    def __init__(self) -> None:
        self.held: Counter = Counter()

    def add(self, lang: str, sources: list[str], k: int, code: np.ndarray, value: np.ndarray) -> None:
        found, at = np.unique(code, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, value)
        for c, x in zip(found.tolist(), total.tolist(), strict=True):
            self.held[lang, sources[c // k], sources[c % k]] += x

    def rows(self) -> pa.RecordBatch:
        lang, a, b = (pa.array([key[i] for key in self.held], pa.string()) for i in range(3))
        made = pa.RecordBatch.from_arrays([lang, pa.array(["pair"] * len(self.held), pa.string()), a, b, pa.array(self.held.values(), pa.int64())], ["lang", "part", "source", "item", "value"])
        self.held = Counter()
        return made


def _best(held: dict[tuple, list], lang: str, sources: list[str], own: np.ndarray, gain: np.ndarray, terms: list[bytes]) -> None:
    """Adds a block's terms to each source's TOP by gain, then by the term's bytes."""
    for s in np.unique(own):
        at = np.flatnonzero(own == s)
        if len(at) > TOP:  # all that reach the TOPth, ties too
            at = at[gain[at] >= np.partition(gain[at], len(at) - TOP)[len(at) - TOP]]
        key = (lang, sources[s])
        held[key] = sorted([*held.get(key, ()), *((-int(gain[i]), terms[i]) for i in at)])[:TOP]


#: Pairs of a block that are made at once.
CELLS = 1 << 20


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over kept terms (lang, term, source, p, p0, q) in this order, a term's rows in one partition: sums C of pairs (source before item), and each source's best terms."""
    sums, best, rest = _Sums(), {}, None

    def block(b: pa.RecordBatch) -> None:
        term_start = np.flatnonzero(_starts(b["lang"], b["term"]))
        lang_of = b["lang"].take(pa.array(term_start))
        edges = [*np.flatnonzero(_starts(lang_of)).tolist(), len(term_start)]
        places = np.append(term_start, b.num_rows)
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            one, lang = b.slice(places[x], places[y] - places[x]), lang_of[x].as_py()
            coded = one["source"].dictionary_encode()
            sources, own = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            p, p0, q = (one[k].to_numpy() for k in ("p", "p0", "q"))
            up = np.flatnonzero(p > q)
            if len(up):
                terms = one["term"].take(pa.array(up)).cast(pa.binary()).to_pylist()
                _best(best, lang, sources, own[up], (p - q)[up], terms)
            length = np.diff(places[x : y + 1])
            after = np.repeat(np.cumsum(length), length) - np.arange(len(own)) - 1  # rows of the same term that follow
            a = 0
            while a < len(own):  # each row with those that follow, CELLS pairs at a time
                z = max(a + 1, a + int(np.searchsorted(np.cumsum(after[a:]), CELLS, "right")))
                i = np.repeat(np.arange(a, z), after[a:z])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[a:z]) - after[a:z], after[a:z])
                # sources ascend within a term, their codes may not
                value = abs(p[i] - p[j]) - abs(p[i] - p0[j]) - abs(p0[i] - p[j]) + abs(p0[i] - p0[j])
                sums.add(lang, sources, len(sources), own[i] * len(sources) + own[j], value)
                a = z

    for b in batches:
        if not b.num_rows:
            continue
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        cut = int(np.flatnonzero(_starts(b["lang"], b["term"]))[-1])  # the last term may go on
        rest = b.slice(cut)
        if cut:
            block(b.slice(0, cut))
        if len(sums.held) >= FLUSH:
            yield sums.rows()
    if rest is not None:
        block(rest)
    yield sums.rows()
    for (lang, source), terms in best.items():
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(terms), pa.string()) for x in (lang, "term", source)] + [pa.array([t.decode() for _, t in terms], pa.string()), pa.array([-g for g, _ in terms], pa.int64())], ["lang", "part", "source", "item", "value"])


def _p(count: str, n: str, v: str) -> str:
    return f"CAST(1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({count} + {ADD} AS DECIMAL(20, 0))) div (CAST({n} AS DECIMAL(20, 0)) + {ADD} * CAST({v} AS DECIMAL(17, 0))) AS BIGINT)"


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source)."""
    shelf = Shelf(lean(docs).sparkSession)
    rows = docs.select(*(F.coalesce(k, F.lit("")).alias(k) for k in ("lang", "source", "text")), F.hash("doc_id", "text").alias("doc"))
    records = rows.select("lang", "source", "doc", "text").mapInArrow(counted, RECORDS).repartition("lang", "term")
    kept = shelf.put(records.sortWithinPartitions("term", "lang", "source", "doc").mapInArrow(run_lengths(LEAST), KEPT))
    langs = kept.groupBy("lang", "term").agg(F.max("all_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(used, ["lang", "source"], "left")
    groups = groups.selectExpr("lang", "source", "coalesce(v, 0) AS v", "coalesce(group_n, 0) AS group_n", "lang_n").selectExpr("*", f"IF(v > 0, {_p('0L', 'group_n', 'v')}, 0) AS p0")
    groups = shelf.put(groups)
    terms = kept.join(groups.where("v > 0"), ["lang", "source"]).selectExpr("lang", "term", "source", f"{_p('n', 'group_n', 'v')} AS p", "p0", f"{_p('all_n', 'lang_n', 'v')} AS q")
    terms = shelf.put(terms)
    scanned = shelf.put(terms.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(shared_terms, SCANNED))
    pairs = _pairs(groups, terms, scanned.where("part = 'pair'"))
    of = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = scanned.where("part = 'term'").select("lang", "source", "item", "value")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(of).alias("rank"))
    return ranked.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(of).alias("rank")).where(f"rank <= {TOP}"))


def _pairs(groups: DataFrame, terms: DataFrame, shared: DataFrame) -> DataFrame:
    """lang, source, item, value for each source and each other of its language: the rows that are asked for."""
    mine, other = groups.select("lang", "source", "v", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("other_p0"))
    both = mine.join(other, "lang").where("source <> item")
    # A: a source's distinct p in order, and between them the p0 of the others, at which the sums so far are read
    steps = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("n"), F.max("p0").alias("p0")).selectExpr("lang", "source", "p AS x", "n", "p0", "CAST(NULL AS STRING) AS item")
    asked = both.selectExpr("lang", "source", "other_p0 AS x", "0L AS n", "p0", "item")
    so_far, all_of = Window.partitionBy("lang", "source").orderBy("x").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("lang", "source")
    at = steps.unionByName(asked).select("*", (F.col("n") * F.col("x")).cast("decimal(38,0)").alias("nx"))
    at = at.select("*", *(F.sum(k).over(w).alias(name) for k, w, name in (("n", so_far, "n0"), ("nx", so_far, "s0"), ("n", all_of, "n1"), ("nx", all_of, "s1")))).where("item IS NOT NULL")
    part = at.selectExpr("lang", "source", "item", "CAST(x * n0 - s0 + (s1 - s0) - x * (n1 - n0) - n1 * abs(p0 - x) AS BIGINT) AS part")
    mirrored = part.selectExpr("lang", "item AS source", "source AS item", "part")
    c = shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("part"))
    c = c.unionByName(c.selectExpr("lang", "item AS source", "source AS item", "part"))
    base = both.selectExpr("lang", "source", "item", "CAST(v * abs(p0 - other_p0) AS BIGINT) AS part")
    return base.unionByName(part).unionByName(mirrored).unionByName(c).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))


_EACH = f"1 + (CAST({UNIT} AS HUGEINT) * ({{}} + {ADD})) // ({{}} + {ADD} * v)"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(ws) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, CAST(count(*) AS BIGINT) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
l AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
dense AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, all_n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
gn AS (SELECT lang, source, sum(n) AS group_n FROM dense GROUP BY lang, source),
p AS MATERIALIZED (SELECT lang, source, term, n, {_EACH.format("n", "group_n")} AS p, {_EACH.format("all_n", "lang_n")} AS q FROM dense JOIN gn USING (lang, source) JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= {TOP}
"""
