"""Near-duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

A text's set holds its distinct five-word shingles after A-Z are lower-cased; a text of
fewer words has its whole sequence as one, and one without words (or null) has none
and is linked with nothing. One hash of each shingle places it in one of BINS bins; a
bin keeps its least hash. An empty bin takes the value of the first filled bin in an
order of its own (optimal densification), which keeps the chance that a bin agrees at
the similarity. Runs of ROWS bins make the buckets. With 48 bands of five, two sets at
similarity 0.75 miss each other with a chance of about 2 in a million.

Rows of one word sequence are one item; its smallest id stands for them. Candidate
pairs are confirmed on the full sets (64-bit shingle hashes), with
100 * intersection >= 75 * union, and every link between different texts that share a
bucket takes effect: see links.py.

Empty tables give empty results. Ties don't arise (ids decide). Rows with a null
doc_id take part in no group: n_shingles is set, component_id is null and kept is true.
Rows that repeat a doc_id share its component; kept is true for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm.links import star_components
from tidewire.llm.store import lean, settle

WORDS, SHARE = 5, 75
BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
SKETCH = "struct<k1: bigint, k2: bigint, n: bigint, bands: array<bigint>>"
#: For each bin the order in which it looks for a filled one.
_ORDER = np.argsort(K.mix(np.arange(BINS * BINS, dtype=K.U) + K.U(1 << 40)).reshape(BINS, BINS), axis=1)
_BAND = K.mix(np.arange(BANDS, dtype=K.U) + K.U(77))


def shingle_sets(text: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order."""
    h, bounds = K.words(text)
    got, at = K.shingles(h, bounds, words)
    return [np.unique(got[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def signature(own: np.ndarray) -> np.ndarray:
    """BINS least hashes of a non-empty ascending set, empty bins densified."""
    bins = ((own >> K.U(32)) * K.U(BINS) >> K.U(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    sig, filled = np.zeros(BINS, K.U), np.zeros(BINS, bool)
    sig[bins[first]], filled[bins[first]] = own[first], True
    if len(first) < BINS:
        empty = np.flatnonzero(~filled)
        sig[empty] = sig[_ORDER[empty, filled[_ORDER[empty]].argmax(axis=1)]]
    return sig


def bands(sigs: np.ndarray) -> np.ndarray:
    """Bucket numbers (int64) of signatures (one a row): a hash of each run of ROWS bins and of the band."""
    parts = K.mix(sigs).reshape(len(sigs), BANDS, ROWS)
    with np.errstate(over="ignore"):
        total = np.zeros((len(sigs), BANDS), K.U)
        for k in range(ROWS):
            total += parts[:, :, k] * K._COEF[k]
        return K.mix(total + _BAND).view(np.int64)


def sketch(text: pa.Array) -> pa.Array:
    """Two hashes of the word sequence, the set's size, and its buckets."""
    k1, k2, sizes, found = [], [], [], []
    for a, b in K.steps(text):
        h, bounds = K.words(text.slice(a, b - a))
        rel = (np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(K.U)
        with np.errstate(over="ignore"):
            k1.append(K.sums(K.mix(h + rel * K._COEF[40]), bounds))
            k2.append(K.sums(K.mix((h ^ K._COEF[41]) + rel * K._COEF[42]), bounds))
        got, at = K.shingles(h, bounds, WORDS)
        sigs = np.zeros((b - a, BINS), K.U)
        for i in range(b - a):
            own = np.unique(got[at[i] : at[i + 1]])
            sizes.append(len(own))
            if len(own):
                sigs[i] = signature(own)
        found.append(bands(sigs))
    flat = np.concatenate(found).reshape(-1) if found else np.zeros(0, np.int64)
    n = len(sizes)
    sizes = np.array(sizes, np.int64)
    flat = flat[np.repeat(sizes > 0, BANDS)]
    at = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
    keys = [pa.array((np.concatenate(k) if k else np.zeros(0, K.U)).view(np.int64)) for k in (k1, k2)]
    return pa.StructArray.from_arrays([*keys, pa.array(sizes), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["k1", "k2", "n", "bands"]) if n else pa.array([], pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))]))


def packed_set(text: pa.Array) -> pa.Array:
    return pa.array([own.tobytes() for a, b in K.steps(text) for own in shingle_sets(text.slice(a, b - a))], pa.binary())


def alike_sets(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_buffer(), K.U), np.frombuffer(y.as_buffer(), K.U)
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        place = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[place] == small).sum())
        out.append(100 * both >= SHARE * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    lean(docs)
    slim = settle(docs.select("doc_id", F.arrow_udf(sketch, SKETCH)(F.col("text")).alias("s")).select("doc_id", "s.*"))
    # one item for each word sequence: its smallest id
    items = settle(slim.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "bands")).alias("i")).select("k1", "k2", "i.*"))
    buckets = items.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), "n")

    def payload(ids: DataFrame) -> DataFrame:
        few = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
        # should ids repeat, one of their texts speaks for them
        return few.select("id", F.arrow_udf(packed_set, "binary")(F.col("text")).alias("own")).dropDuplicates(["id"])

    comp = star_components(buckets, payload, alike_sets, f"100 * least(n, m) >= {SHARE} * greatest(n, m)")
    named = items.select("k1", "k2", "doc_id").join(comp, F.col("doc_id") == F.col("id"), "left").select("k1", "k2", F.coalesce("comp", "doc_id").alias("group"))
    made = slim.where("n > 0 AND doc_id IS NOT NULL").join(named, ["k1", "k2"]).select("doc_id", "n", F.col("group"))
    alone = slim.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("group"))
    return made.union(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("group").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("group"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that aren't their group's first."""
    gone = groups(docs).where("NOT kept").select("doc_id").distinct()
    return docs.alias("all").join(gone.alias("gone"), F.col("all.doc_id") == F.col("gone.doc_id"), "left_anti")


#: Exact links by counting shared shingles, then a recursive walk: for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS cut FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * cut >= 75 * (x.n + y.n - cut)),
t AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS got FROM w UNION SELECT r.doc_id, t.v FROM r JOIN t ON r.got = t.u),
c AS (SELECT doc_id, min(got) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON w.doc_id = c.doc_id LEFT JOIN n ON w.doc_id = n.doc_id
"""
