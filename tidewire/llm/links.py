"""Links between items that share a bucket, checked on their full data, and the components they form.

Buckets hold star-shaped candidate edges: each member is paired with the bucket's
leader, so a bucket of n members gives n - 1 pairs. The leader is the member that shares
most places in buckets over all its buckets: the original among its variants. Checks
come in four rounds, each followed by components, and a pair whose ends are already in
one component isn't checked:

1. each item with the leader that it shares most buckets with;
2. each item with its other leaders;
3. buckets that still hold several components: in those of up to SMALL members all pairs
   of different components, in larger ones a second star around the most central member
   outside the bucket's largest component;
4. the exact rest: in larger buckets that still hold several components, every member
   outside the largest against all members of other components. Members are dealt in
   blocks of about BLOCK in size, and a task compares two blocks in memory: rows grow
   with the number of blocks, and no pair becomes a row.

After these, two members of one bucket that are linked are in one component.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.store import Shelf


#: Rows of a table that one task takes; tables of links are small beside the corpus.
LEAN = 50_000


def components(edges: DataFrame, at: DataFrame | None = None, shelf: Shelf | None = None) -> DataFrame:
    """(id, comp) for each end of ``edges`` (u, v): comp is the smallest id that is reachable.

    Labels pass over edges and then to the label of the label (pointer jumping), so
    rounds grow with the logarithm of a path's length. Each round is written to the
    shared folder and the one before deleted. A node with very many edges is summed on the map side
    first. With ``at``, the labels so far, only the graph of labels that new edges join is walked.
    """
    shelf = shelf or Shelf(edges.sparkSession)
    if at is not None:
        return _joined(edges, at, shelf)
    both = shelf.put(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).where("u <> v").distinct())
    tasks = both.count() // LEAN + 1
    at = shelf.put(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.lit(0).cast("long").alias("old"), F.least("u", "v").alias("comp")), tasks)
    while True:
        near = both.join(at.select(F.col("id").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        step = shelf.put(at.drop("old").join(near, F.col("id") == F.col("u")).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), tasks)
        jump = step.select(F.col("id").alias("old_comp"), F.col("comp").alias("far"))
        done = shelf.put(step.join(jump, F.col("comp") == F.col("old_comp"), "left").select("id", "old", F.least("comp", "far").alias("comp")), tasks)
        changed = done.where("old <> comp").limit(1).count()
        shelf.drop(at, step)
        at = done
        if not changed:
            shelf.drop(both)
            return at.select("id", "comp")


def _joined(edges: DataFrame, at: DataFrame, shelf: Shelf) -> DataFrame:
    u, v = (at.select(F.col("id").alias(k), F.col("comp").alias(f"comp_{k}")) for k in "uv")
    labels = edges.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("comp_u", "u").alias("u"), F.coalesce("comp_v", "v").alias("v"))
    merged = components(labels, shelf=shelf)
    moved = at.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to_comp")), "comp", "left").select("id", F.coalesce("to_comp", "comp").alias("comp"))
    fresh = merged.join(at, "id", "left_anti").select("id", "comp")
    return shelf.put(moved.union(fresh), at.count() // LEAN + 2)


#: Members up to which a bucket's pairs are all checked.
SMALL = 6
#: Sum of the sizes of a block of a larger bucket's members, and bytes of full data that are compared in one step.
BLOCK, STEP = 1 << 17, 1 << 22


def star_components(buckets: DataFrame, payload: Callable[[DataFrame], DataFrame], linked: Callable[[pa.Array, pa.Array], pa.Array], could: str = "true", keep: bool = True) -> DataFrame:
    """(id, comp) of the items of ``buckets`` (bucket long, id long, n long) that have a link.

    payload: from items (id) their full data (id, own), for those that share a bucket; with ``keep`` it is
    written once, else read anew in each round (where it is a table already). linked: whether the values of two arrays of such data are links. could: SQL condition on
    ``n`` and ``m``, the two items' sizes, that a link can't fail.
    """
    shelf, check = Shelf(buckets.sparkSession), F.arrow_udf(linked, "boolean")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    held = shelf.put(buckets.join(shared, "bucket"))
    score = shelf.put(held.groupBy("id").agg(F.sum("members").alias("score")))
    own = payload(score.select("id"))
    own = shelf.put(own) if keep else own
    lead = held.join(score, "id").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"), "n")).alias("lead"))
    lead = lead.select("bucket", (-F.col("lead.minus")).alias("lead"), F.col("lead.score").alias("lead_score"), F.col("lead.n").alias("m"))

    def links(pairs: DataFrame) -> DataFrame:
        u, v = (own.select(F.col("id").alias(k), F.col("own").alias(f"own_{k}")) for k in "uv")
        return shelf.put(pairs.join(u, "u").join(v, "v").where(check("own_u", "own_v")).select("u", "v"))

    pairs = shelf.put(held.join(lead, "bucket").where(f"id <> lead AND {could}").groupBy("id", "lead").agg(F.count("*").alias("count"), F.first("lead_score").alias("lead_score")))
    best = shelf.put(pairs.groupBy("id").agg(F.max_by("lead", F.struct("count", "lead_score", "lead")).alias("lead")))
    at = components(links(_ordered(best, "lead", "id")), shelf=shelf)
    rest = _apart(pairs.join(best, ["id", "lead"], "left_anti"), at, "lead", "id")
    at = components(links(_ordered(rest, "lead", "id")), at, shelf)
    named = held.join(at, "id", "left").select("bucket", "id", "n", "members", F.coalesce("comp", "id").alias("comp"))
    kinds = named.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    mixed = kinds.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("bucket", F.col("main.comp").alias("main"))
    left = shelf.put(named.join(mixed, "bucket").join(score, "id"))
    shelf.drop(held, best)
    stray = left.where("comp <> main").select("bucket", F.col("id").alias("id_"), F.col("n").alias("m"), F.col("comp").alias("comp_"), "members", "score")
    second = stray.where(f"members > {SMALL}").groupBy("bucket").agg(F.max_by(F.struct("id_", "m", "comp_"), F.struct("score", -F.col("id_"))).alias("s")).select("bucket", "s.*")
    few = stray.where(f"members <= {SMALL}").select("bucket", "id_", "m", "comp_")
    cross = left.join(second.union(few), "bucket").where(f"comp <> comp_ AND {could}")
    known = _ordered(pairs, "lead", "id")
    at = components(links(_ordered(cross, "id", "id_").join(known, ["u", "v"], "left_anti")), at, shelf)
    cells = shelf.put(_cells(left.where(f"members > {SMALL}").select("bucket", "id", "n"), at))
    if cells.limit(1).count():
        found = cells.join(own, "id").groupBy("bucket", "x", "y", "main").applyInArrow(_between(linked), "u long, v long")
        at = components(shelf.put(found), at, shelf)
    return shelf.keep_only(at)


def _cells(left: DataFrame, at: DataFrame) -> DataFrame:
    """(id, comp, bucket, x, y, main, side): a row for each pair of blocks (x, y) in which a member of a mixed bucket is compared.

    x is a block of members outside the bucket's largest component; so is y, or with ``main`` a block of that component.
    """
    named = left.join(at, "id", "left").select("bucket", "id", "n", F.coalesce("comp", "id").alias("comp"))
    kinds = named.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    mixed = kinds.groupBy("bucket").agg(F.max(F.struct("k", "comp", "size")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.selectExpr("bucket", "top.comp AS top", f"int(top.size div {BLOCK}) AS mains", f"int((all - top.size) div {BLOCK}) AS strays")  # the last block of each
    dealt = named.join(mixed, "bucket").withColumn("own_block", F.expr("int(pmod(xxhash64(id), 1 + IF(comp = top, mains, strays)))"))
    with_strays = "transform(sequence(0, strays), j -> struct(least(own_block, j) AS x, greatest(own_block, j) AS y, false AS main, int(own_block > j) AS side))"
    with_main = "transform(sequence(0, mains), j -> struct(own_block AS x, j AS y, true AS main, 0 AS side))"
    of_main = "transform(sequence(0, strays), j -> struct(j AS x, own_block AS y, true AS main, 1 AS side))"
    return dealt.selectExpr("id", "comp", "bucket", f"explode(IF(comp = top, {of_main}, concat({with_strays}, {with_main}))) AS c").select("id", "comp", "bucket", "c.*")


def _between(linked: Callable[[pa.Array, pa.Array], pa.Array]) -> Callable[[pa.Table], pa.Table]:
    """applyInArrow function: links (u, v) that join the components of two blocks, or of one where x = y."""

    def found(rows: pa.Table) -> pa.Table:
        ids, label, side = (rows[k].to_numpy().copy() for k in ("id", "comp", "side"))
        own = pa.concat_arrays(rows["own"].chunks)
        size = np.array([len(x.as_buffer()) for x in own], np.int64)
        one, u, v = not side.any(), [], []
        for i in np.flatnonzero(side == 0):
            others = np.arange(i + 1, len(ids)) if one else np.flatnonzero(side == 1)
            others = others[label[others] != label[i]]
            while len(others):
                k = max(1, int(np.searchsorted(np.cumsum(size[others] + size[i]), STEP)))
                some, others = others[:k], others[k:]
                same = linked(own.take(pa.array(np.full(len(some), i))), own.take(pa.array(some))).to_numpy(zero_copy_only=False)
                for j in some[same]:
                    if label[j] != label[i]:
                        u.append(ids[i])
                        v.append(ids[j])
                        label[label == label[j]] = label[i]
                others = others[label[others] != label[i]]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return found


def _ordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _apart(rows: DataFrame, at: DataFrame, a: str, b: str) -> DataFrame:
    """The rows whose ends are in different components."""
    x, y = (at.select(F.col("id").alias(k), F.col("comp").alias(f"comp_{k}")) for k in (a, b))
    return rows.join(x, a, "left").join(y, b, "left").where(F.coalesce(F.col(f"comp_{a}"), F.col(a)) != F.coalesce(F.col(f"comp_{b}"), F.col(b)))
