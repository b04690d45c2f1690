"""Personal data: fixed patterns, and information-theoretic sanitisation of terms that disclose what the patterns protect.

The patterns find e-mail and IP addresses, card and telephone numbers. Beside them, a run of SECRET signs and more of
letters and digits (both) whose own sign frequencies carry SECRET_BITS bits is a ``secret`` (keys, tokens): n_private counts
it with the patterns. Other kinds (names, postal addresses, numbers of documents) are found only as terms that disclose. Each value of a pattern
is a protected entity. A term discloses an entity as far as the corpus shows them
together: with p(e|t) the share of the term's documents that hold the entity, within
NEAR words or anywhere in the text (the larger counts), disclosure = PMI(t; e) / IC(e) = 1 - log p(e|t) / log p(e),
which is 1 where the term gives the entity away; an entity that stands in every document carries no information, and its disclosure is 0. Terms of any length at THRESHOLD or above, seen
with the entity in at least SUPPORT different contexts (the words around the entity, or
around the term; copies of one passage count once), become spans of kind ``term``
wherever they stand in any text, but for places inside pattern spans. Sanitised texts have pattern spans and terms at REMOVE
replaced by their kind, and other terms generalised to their first letter.

Counts of terms and entities cover every document, and come first. As p(e|t) is at most the entity's documents over the
term's, most pairs can't reach the threshold. A text that holds an entity which could be disclosed gives a row for each of its terms, not for
each pair: these rows meet the terms' counts, and then the text's entities, and only pairs that the counts of both allow
come out. So rows are bounded by the words of texts with personal data, and a list of many addresses multiplies only terms that are rare enough for one of
them. Two tables of fixed size, by hash prefix (PREFIX bits), of the least count of a term and the largest of an entity keep most rows from being made on smaller corpora; with
more terms than prefixes they let more rows through and no pair. Places of terms are found likewise by a bitmap of prefixes, then by the terms themselves.

Null and empty texts have no spans. Texts are searched whole. Rows that repeat are
counted as they stand, and all get the same spans; null ids are no obstacle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.store import lean, settle

NEAR, SUPPORT, THRESHOLD, REMOVE, PREFIX = 8, 3, 0.8, 0.95, 20
SECRET, SECRET_BITS = 20, 64.0
#: Disclosing terms up to which they are broadcast (24 bytes each); more are joined by shuffle, where adaptive execution splits a frequent one.
FEW = 1 << 16
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
_RUN = re.compile(rf"[A-Za-z0-9_+/=-]{{{SECRET},}}")
#: Signs on either side in which the NEAR words are looked for first.
_REACH = 40 * NEAR


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: what may stand before it is unbroken, so each sign is looked at once."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            low = end = m.end()
            yield start, end
        at = text.find("@", end)


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 12:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def secrets(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs that look drawn by chance: letters and digits, and enough bits by the frequencies of their own signs."""
    out = []
    for m in _RUN.finditer(text):
        run = m[0]
        digits, letters = sum(c.isdigit() for c in run), sum(c.isalpha() for c in run)
        if digits < 4 or letters < 4 or any(a < m.end() and b > m.start() for _, a, b in spans):
            continue
        bits = -sum(n * math.log2(n / len(run)) for n in Counter(run).values())
        if bits >= SECRET_BITS:
            out.append(("secret", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def near_terms(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of the NEAR words on each side; looked for further away while there are fewer."""
    reach = _REACH
    while True:
        left, right = max(0, start - reach), min(len(text), end + reach)
        before = [m.span() for m in _TERM.finditer(text, left, start) if m.start() > left or not left]
        after = [m.span() for m in _TERM.finditer(text, end, right) if m.end() < right or right == len(text)]
        if (len(before) >= NEAR or not left) and (len(after) >= NEAR or right == len(text)):
            return [(a, b) for a, b in before[-NEAR:] + after[:NEAR]]
        reach *= 8


def entity(text: str, kind: str, start: int, end: int) -> str:
    return f"{kind} {text[start:end] if kind in ('email', 'ip') else ''.join(_DIGITS.findall(text[start:end]))}"


FOUND = "struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, n_private: bigint, base: string, base_sha256: string, more: string, es: array<bigint>, near: array<struct<e: bigint, t: bigint, c: bigint, a: int, b: int>>>"
_NEAR = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("c", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))


def _hashed(values: list[str]) -> list[int]:
    """Hashes of non-empty strings, A-Z lower-cased; a whole string is hashed as one run."""
    data, offsets = K.view(pa.array(values, pa.string()))
    return K.hashes(K.LOWER[data], offsets[:-1], offsets[1:]).view(np.int64).tolist()


def find(text: pa.Array) -> pa.Array:
    counts, bases, shas, also, near, ents, keys = [], [], [], [], [], [], []
    for x in text:
        value = x.as_py() or ""
        spans = base_spans(value)
        kinds = [k for k, _, _ in spans]
        found = secrets(value, spans)
        counts.append([*(kinds.count(k) for k in KINDS), len(spans) + len(found)])
        also.append(joined(found))
        bases.append(joined(spans))
        shas.append(hashlib.sha256(bases[-1].encode()).hexdigest())
        mine, own = [], []
        for kind, a, b in spans:
            places = near_terms(value, a, b)
            terms = [value[i:j] for i, j in places]
            first = len(keys)
            own.append(first)
            keys += [entity(value, kind, a, b), " ".join(terms) or " ", *terms]
            mine += [(first, first + 2 + k, first + 1, i, j) for k, (i, j) in enumerate(places)]
        near.append(mine)
        ents.append(own)
    h = _hashed(keys) if keys else []
    near = pa.array([[{"e": h[e], "t": h[t], "c": h[c], "a": a, "b": b} for e, t, c, a, b in mine] for mine in near], _NEAR)
    n = np.array(counts, np.int64).reshape(-1, 5)
    columns = [*(pa.array(n[:, k]) for k in range(5)), *(pa.array(x, pa.string()) for x in (bases, shas, also)), pa.array([sorted({h[e] for e in own}) for own in ents], pa.list_(pa.int64())), near]
    return pa.StructArray.from_arrays(columns, ["n_email", "n_ip", "n_card", "n_phone", "n_private", "base", "base_sha256", "more", "es", "near"])


def terms_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, and start and end in code points of each term, in order."""
    data, offsets = K.view(text)
    letter = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    turn = np.diff(letter.astype(np.int8), prepend=0, append=0)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = edge[1:-1] & letter[1:] & letter[:-1] if len(data) else np.zeros(0, bool)
    cut = np.flatnonzero(inside) + 1  # a text ends and the next begins within letters
    starts = np.sort(np.concatenate([np.flatnonzero(turn == 1), cut]))
    ends = np.sort(np.concatenate([np.flatnonzero(turn == -1), cut]))
    row = np.searchsorted(offsets, starts, "right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = points[offsets[row]]
    return row, K.hashes(K.LOWER[data], starts, ends), points[starts] - first, points[ends] - first


def _at(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A table's values (a power of two of them) by the prefixes of hashes."""
    return table[(h.view(K.U) >> K.U(65 - len(table).bit_length())).astype(np.int64)]


def _free(spans: list[tuple[str, int, int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the ranges touch no span."""
    free = np.ones(len(a), bool)
    for _, i, j in spans:
        free[np.searchsorted(b, i, "right") : np.searchsorted(a, j)] = False
    return free


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (t, docs), the documents of a step that hold each term."""
    for batch in batches:
        text = batch.column(0)
        for a, b in K.steps(text):
            doc, h, _, _ = terms_of(text.slice(a, b - a))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            seen, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], ["t", "docs"])


def together(most: np.ndarray, least: np.ndarray):
    """mapInArrow function: (doc_id, fp, t, c) for each term, outside spans, of a text with an entity that could be disclosed; c is the hash of the words around the term's first place.

    most, least: by prefix, the largest count of documents of which an entity could be disclosed (0: none), and the least count of a term. They only leave out what no count allows.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.steps(batch.column(2)):
                text = batch.column(2).slice(a, b - a)
                for i, value in enumerate(text.to_pylist()):
                    spans = base_spans(value or "")
                    es = np.array(sorted(set(_hashed([entity(value, *s) for s in spans]))) if spans else [], np.int64)
                    limit = _at(most, es)
                    es, limit = es[limit > 0], limit[limit > 0]
                    if not len(es):
                        continue
                    _, h, start, end = terms_of(text.slice(i, 1))
                    with np.errstate(over="ignore"):
                        padded, c = np.concatenate([np.zeros(NEAR, K.U), h, np.zeros(NEAR, K.U)]), np.zeros(len(h), K.U)
                        for k in range(2 * NEAR + 1):
                            c += padded[k : k + len(h)] * K._COEF[k]
                        c = K.mix(c)
                    free = _free(spans, start, end)
                    t, at = np.unique(h[free], return_index=True)
                    c, count = c[free][at].view(np.int64), _at(least, t)
                    t = t.view(np.int64)
                    own = count <= limit.max()
                    if m := int(own.sum()):
                        ids = pa.array([batch.column(0)[a + i].as_py()] * m, batch.schema.field(0).type)
                        yield pa.RecordBatch.from_arrays([ids, pa.array([batch.column(1)[a + i].as_py()] * m, pa.int64()), pa.array(t[own]), pa.array(c[own])], ["doc_id", "fp", "t", "c"])

    return pair


def places(bitmap: np.ndarray):
    """mapInArrow function: (doc_id, fp, t, a, b) for each place, outside spans, of a term whose prefix is in the bitmap."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.steps(batch.column(2)):
                text = batch.column(2).slice(a, b - a)
                row, h, start, end = terms_of(text)
                keep = _at(bitmap, h)
                row, h, start, end = row[keep], h[keep], start[keep], end[keep]
                free = np.ones(len(row), bool)
                edges = np.searchsorted(row, np.arange(b - a + 1))
                for i in np.flatnonzero(np.diff(edges)):
                    mine = slice(edges[i], edges[i + 1])
                    free[mine] = _free(base_spans(text[int(i)].as_py()), start[mine], end[mine])
                rows = pa.array(row[free] + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h[free].view(np.int64)), pa.array(start[free].astype(np.int32)), pa.array(end[free].astype(np.int32))], ["doc_id", "fp", "t", "a", "b"])

    return place


def _by_prefix(table: DataFrame, column: str, value, empty: float) -> np.ndarray:
    """A value for each hash prefix of the column: at most 2**PREFIX rows are collected, whatever the corpus."""
    got = table.groupBy(F.shiftrightunsigned(column, 64 - PREFIX).alias("p")).agg(value.cast("double").alias("v")).toArrow()
    out = np.full(1 << PREFIX, empty, np.float32)
    out[got["p"].to_numpy()] = got["v"].to_numpy()
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("fp"), "text")


def _id(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint"


def disclosing(docs: DataFrame, rows: DataFrame, near: int = NEAR, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(e, t, disclosure) of terms that disclose an entity. rows: doc_id, fp, es, near."""
    seen = rows.where("size(near) > 0").select("doc_id", "fp", F.explode("near").alias("x")).select("doc_id", "fp", "x.*")
    # a document counts once; rows that repeat whole are one document here
    entity = settle(rows.select("doc_id", "fp", F.explode("es").alias("e")).distinct().groupBy("e").agg(F.count("*").alias("entity_docs")))
    terms = settle(docs.select("text").mapInArrow(count_terms, "t bigint, docs bigint").groupBy("t").agg(F.sum("docs").alias("df")))
    total = float(max(2, rows.count()))
    # disclosure >= threshold asks for p(e|t) >= p(e) ** (1 - threshold), and p(e|t) is at most entity_docs / df;
    # only an entity of SUPPORT documents has as many texts that a term shares with it
    informs = entity.where((F.col("entity_docs") >= support) & (F.col("entity_docs") < total))
    up = F.col("entity_docs") * F.pow(total / F.col("entity_docs"), F.lit(1 - threshold)) * 1.001
    informs = settle(informs.select("e", up.alias("up")))
    words = _texts(docs).mapInArrow(together(_by_prefix(informs, "e", F.max("up"), 0.0), _by_prefix(terms, "t", F.min("df"), np.inf)), f"{_id(docs)}, t bigint, c bigint").distinct()
    held = rows.select(F.col("doc_id").alias("id_"), F.col("fp").alias("fp_"), F.explode("es").alias("e")).distinct().join(informs, "e")
    whole = words.join(terms, "t").join(held, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("fp") == F.col("fp_"))).where("df <= up")
    both = seen.select("doc_id", "fp", "e", "t", "c", F.lit(False).alias("w")).union(whole.select("doc_id", "fp", "e", "t", "c", F.lit(True)))
    pairs = both.groupBy("e", "t", "w", "c", "doc_id", "fp").agg(F.lit(1).alias("one")).groupBy("e", "t", "w", "c").agg(F.count("*").alias("docs"))
    pairs = pairs.groupBy("e", "t", "w").agg(F.sum("docs").alias("together"), F.count("*").alias("contexts"))
    pairs = settle(pairs.groupBy("e", "t").agg(F.max("together").alias("together"), F.max("contexts").alias("contexts")).where(F.col("contexts") >= support))
    of_term = F.least(F.col("together") / F.col("df"), F.lit(1.0))
    score = F.when(F.col("entity_docs") >= total, 0.0).otherwise(1 - F.log(of_term) / F.log(F.least(F.col("entity_docs") / total, F.lit(1 - 1e-12))))
    return pairs.join(terms, "t").join(entity, "e").withColumn("disclosure", score).where(F.col("disclosure") >= threshold).select("e", "t", "disclosure")


def detect(docs: DataFrame, **how) -> DataFrame:
    """doc_id, fp (hash of the text), counts by kind, n_private, base, base_sha256, more (secrets), terms (array of start, end, disclosure), spans for every row of ``docs``."""
    lean(docs)
    rows = settle(docs.select("doc_id", F.xxhash64("text").alias("fp"), F.arrow_udf(find, FOUND)(F.col("text")).alias("f")).select("doc_id", "fp", "f.*"))
    told = settle(disclosing(docs, rows, **how).groupBy("t").agg(F.max("disclosure").alias("disclosure")))
    # every place of a disclosing term in every text; the terms are sent to all tasks where they are few, by count
    few = F.broadcast(told) if told.count() <= FEW else told
    hits = _texts(docs).mapInArrow(places(_by_prefix(told, "t", F.count("*"), 0.0) > 0), f"{_id(docs)}, t bigint, a int, b int").join(few, "t")
    terms = hits.groupBy("doc_id", "fp", "a", "b").agg(F.max("disclosure").alias("disclosure")).groupBy("doc_id", "fp").agg(F.array_sort(F.collect_list(F.struct("a", "b", "disclosure"))).alias("terms"))
    right = terms.select(F.col("doc_id").alias("id_"), F.col("fp").alias("fp_"), "terms")
    made = rows.drop("near", "es").join(right, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("fp") == F.col("fp_")), "left").drop("id_", "fp_")
    also = F.transform(F.coalesce("terms", F.array()), lambda x: F.concat(F.lit("term:"), x["a"].cast("string"), F.lit(":"), x["b"].cast("string")))
    return made.withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("more") != "", F.col("more")), also))


def sanitised(docs: DataFrame, remove: float = REMOVE, **how) -> DataFrame:
    """doc_id, text of every row: base spans, secrets and terms at ``remove`` give way to [kind], other disclosing terms to their first letter and an ellipsis."""
    found = detect(docs, **how).select(F.col("doc_id").alias("id_"), F.col("fp").alias("fp_"), F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif("more", F.lit(""))).alias("base"), "terms").where("base <> '' OR terms IS NOT NULL").dropDuplicates(["id_", "fp_"])

    def rewrite(text: pa.Array, base: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for x, spans, own in zip(text.to_pylist(), base.to_pylist(), terms.to_pylist(), strict=True):
            cuts = [(int(a), int(b), f"[{k}]") for k, a, b in (s.split(":") for s in spans.split(","))] if spans else []
            cuts += [(t["a"], t["b"], "[term]" if t["disclosure"] >= remove else x[t["a"]] + "…") for t in own or []]
            parts, at = [], 0
            for a, b, new in sorted(cuts):
                if a >= at:
                    parts += [x[at:a], new]
                at = max(at, b)
            out.append(x if x is None else "".join(parts) + x[at:])
        return pa.array(out, pa.string())

    text = docs.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    both = text.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("fp") == F.col("fp_")), "left")
    return both.select("doc_id", F.arrow_udf(rewrite, "string")("text", "base", "terms").alias("text"))
