"""Centroid clustering by Exponion search: Lloyd's rounds with exact integer distances, in which few centroids are looked at.

A vector is kept if it has exactly DIM components, none null or non-finite; a component x becomes
floor(SCALE * x), held to +-LIMIT so that a squared distance fits a long. The first centroids are the k kept
vectors with the smallest SHA-256 (lowercase hex) of ``seed:vec_id``, in that order (ties, as of repeated
ids: by components; null ids last). With fewer than k kept vectors there are as many centroids. Each round assigns
every vector to its nearest centroid (ties: smaller number), and a centroid with vectors becomes the floor of
their mean, by exact sums; one without stays. After the last round vectors are assigned once more.

A vector carries its centroid a, an upper bound u of the distance to it and a lower bound l of the distance
to any other. Centroids move, bounds are loosened by how far. With s half the distance from a to
its nearest other centroid: if u < max(l, s), nothing changes. Else u is made exact, and if that
doesn't decide, only centroids in the ball of radius 2u + 2s around a are looked at, a prefix of a's list of the others by
distance: both the nearest and the second nearest are in it. Bounds are rounded outwards, comparisons that
skip work are strict and the ball includes its surface, so ties are always looked at; distances that decide are integers.

State (vector, a, bounds) is a table in the shared folder; each round reads one, writes the next and deletes the
former: a lost task is made again from it. The new centroids come from sums of the vectors
that moved, by (centroid, component), so at most k * DIM numbers reach the driver, whatever the table's size; so does
what tasks are given (centroids, their distances). No vector is shuffled.

Rows that repeat a vec_id are vectors each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.store import Shelf, lean

DIM, SCALE, K_CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
LIMIT = 1 << 27
#: By this share bounds are rounded outwards: over what square roots and sums of doubles lose.
SLACK = 1e-12
STATE = "vec_id long, v binary, before int, a int, u double, l double"


def packed(column: pa.Array, dim: int = DIM, scale: int = SCALE) -> pa.Array:
    """The integers (packed 32-bit) of each list of numbers, null if it isn't kept."""
    column = column.cast(pa.list_(pa.float64()))
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # null lists have no values
    at = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    x = flat.to_numpy(zero_copy_only=False)  # null components are NaN
    whole, out = size == dim, [None] * len(column)
    rows = x[(at[:-1][whole][:, None] + np.arange(dim)).reshape(-1)].reshape(-1, dim) if whole.any() else np.zeros((0, dim))
    fine = np.isfinite(rows).all(axis=1)
    with np.errstate(over="ignore"):
        made = np.clip(np.floor(rows[fine] * scale), -LIMIT, LIMIT).astype("<i4")
    for i, row in zip(np.flatnonzero(whole)[fine], made, strict=True):
        out[i] = row.tobytes()
    return pa.array(out, pa.binary())


@dataclass(frozen=True)
class Centroids:
    """Places of the centroids (k x dim), how far each moved, and for each the others by distance."""

    at: np.ndarray
    moved: np.ndarray

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """For each centroid the numbers of the others by distance, and these distances (rounded down)."""
        far = np.sqrt(((self.at[:, None] - self.at[None]) ** 2).sum(axis=2).astype(float)) * (1 - SLACK)
        np.fill_diagonal(far, -1)  # itself comes first and goes
        order = np.argsort(far, axis=1, kind="stable")[:, 1:]
        return order, np.take_along_axis(far, order, axis=1)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v.astype(np.int64) - c
    return (d * d).sum(axis=1)


def nearest(v: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, upper and lower bound of each vector, by looking at all."""
    d = np.stack([squared(v, x) for x in c.at], axis=1)
    a = d.argmin(axis=1)  # the first of equal ones
    own = d[np.arange(len(v)), a]
    rest = d.copy()
    rest[np.arange(len(v)), a] = np.iinfo(np.int64).max
    low = rest.min(axis=1) if d.shape[1] > 1 else np.full(len(v), np.iinfo(np.int64).max)
    return a.astype(np.int32), np.sqrt(own) * (1 + SLACK), np.sqrt(low) * (1 - SLACK)


def exponion(v: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, c: Centroids, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroid and bounds after ``c`` has moved, from those before. looked: gets the number of distances that were computed."""
    k = len(c.at)
    others = np.array([np.delete(c.moved, j).max(initial=0.0) for j in range(k)])
    u, low = (u + c.moved[a]) * (1 + SLACK), np.maximum(0, (low - others[a]) * (1 - SLACK) - SLACK)
    if k == 1:
        return a, u, low
    order, far = c.lists()
    half = far[:, 0] / 2 * (1 - SLACK)
    a, count = a.copy(), 0
    todo = np.flatnonzero(~(u < np.maximum(low, half[a])))
    own = np.zeros(len(v), np.int64)
    for j in range(k):
        at = todo[a[todo] == j]
        own[at] = squared(v[at], c.at[j])
        count += len(at)
    u[todo] = np.sqrt(own[todo]) * (1 + SLACK)
    todo = todo[~(u[todo] < np.maximum(low[todo], half[a[todo]]))]
    before = a[todo]
    for j in range(k):
        at = todo[before == j]
        if not len(at):
            continue
        best, best_d, second = np.full(len(at), j), own[at].copy(), np.full(len(at), np.iinfo(np.int64).max)
        # how many of j's list are in each vector's ball, the surface included
        reach = np.searchsorted(far[j], (2 * u[at] + 2 * half[j]) * (1 + 4 * SLACK), "right")
        for n, x in enumerate(order[j]):
            some = np.flatnonzero(reach > n)
            if not len(some):
                break
            d = squared(v[at[some]], c.at[x])
            count += len(some)
            win = (d < best_d[some]) | (d == best_d[some]) & (x < best[some])
            second[some] = np.minimum(second[some], np.where(win, best_d[some], d))
            best[some], best_d[some] = np.where(win, x, best[some]), np.where(win, d, best_d[some])
        a[at], u[at], low[at] = best, np.sqrt(best_d) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
    if looked is not None:
        looked.append(count)
    return a, u, low


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dim), "<i4")
    _, places, data = column.buffers()
    start = int(np.frombuffer(places, np.int32)[column.offset])
    return np.frombuffer(data, "<i4", count=len(column) * dim, offset=start).reshape(-1, dim)


def _rounds(c: Centroids, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: states against the centroids."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b["v"], c.at.shape[1])
            before = b["a"].to_numpy()
            a, u, low = nearest(v, c) if first else exponion(v, before, b["u"].to_numpy().copy(), b["l"].to_numpy().copy(), c)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(before), pa.array(a.astype(np.int32)), pa.array(u), pa.array(low)], ["vec_id", "v", "before", "a", "u", "l"])

    return step


def _sums(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: by centroid and component what vectors that moved add, or with their former centroid take away; component ``dim`` is their count."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.concatenate([_matrix(b["v"], dim).astype(np.int64), np.ones((b.num_rows, 1), np.int64)], axis=1)
            rows = {}
            for name, sign in (("a", 1), ("before", -1)):
                at = b[name].to_numpy()
                for j in np.unique(at[at >= 0]):
                    rows[int(j)] = rows.get(int(j), 0) + sign * v[at == j].sum(axis=0)
            for j, x in rows.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1, j, np.int32)), pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(x)], ["j", "i", "x"])

    return step


def _distances(c: Centroids) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def found(v: pa.Array, a: pa.Array) -> pa.Array:
        return pa.array(squared(_matrix(v, c.at.shape[1]), c.at[a.to_numpy()])) if len(a) else pa.array([], pa.int64())

    return found


def clustered(vectors: DataFrame, k: int = K_CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for every kept row of ``vectors`` (vec_id, embedding)."""
    spark, shelf = lean(vectors).sparkSession, Shelf(vectors.sparkSession)

    def kept(e: pa.Array) -> pa.Array:
        return packed(e, dim, scale)

    made = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.arrow_udf(kept, "binary")(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    none = F.lit(-1).cast("int")
    state = shelf.put(made.select("vec_id", "v", none.alias("before"), none.alias("a"), F.lit(0.0).alias("u"), F.lit(0.0).alias("l")))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = state.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    at = np.stack([np.frombuffer(r["v"], "<i4") for r in start]).astype(np.int64)
    moved, total = np.zeros(len(at)), np.zeros((len(at), dim + 1), object)
    for n in range(rounds + 1):
        c = Centroids(at, moved)
        after = shelf.put(state.mapInArrow(_rounds(c, n == 0), STATE))
        shelf.drop(state)
        state = after
        if n == rounds:
            break
        sums = state.where("a <> before").mapInArrow(_sums(dim), "j int, i int, x long").groupBy("j", "i").agg(F.sum("x").alias("x"))
        for r in sums.collect():  # k * (dim + 1) rows at most
            total[r["j"], r["i"]] += r["x"]
        new = np.array([[int(x) // int(t[dim]) for x in t[:dim]] if t[dim] else old for t, old in zip(total, at.tolist(), strict=True)], np.int64)
        moved = np.sqrt(((new - at) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        at = new
    c = Centroids(at, moved)
    named = shelf.put(state.select("vec_id", F.col("a").alias("cluster"), F.arrow_udf(_distances(c), "long")("v", "a").alias("distance")))
    shelf.drop(state)
    inertia = {r["cluster"]: r["s"] for r in named.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in at.tolist()]
    per = spark.createDataFrame([(j, s, sum(inertia.values()), digest[j]) for j, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return named.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K_CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> str:
    """SQL that looks at all centroids in every round."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, embedding AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"x AS MATERIALIZED (SELECT vec_id, r, i, CAST(floor({scale} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dim + 1}) t(i))",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), r) - 1 AS j FROM kept ORDER BY j LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT j, i, x AS c FROM s JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, j, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{n} USING (i) GROUP BY r, j)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, j, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if n < rounds:
            mean = "CAST(sum(x) AS BIGINT) // count(*) - CASE WHEN CAST(sum(x) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END"
            parts.append(f"m{n} AS (SELECT j, i, {mean} AS c FROM a{n} JOIN x USING (r) GROUP BY j, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT j, i, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (j, i))")
    parts.append(f"h AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)")
    return f"""WITH {", ".join(parts)}
SELECT k.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN kept k USING (r) JOIN h USING (j)"""


ORACLE = oracle()
