"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards, under quotas, and shards have row counts at most one apart.

Links are star-shaped: documents that hold the same hub are neighbours. Equal texts
share a hub, and so may documents of ``links`` (doc_id, hub). Labels start as the hash of
the id. In each round every hub sums the labels that its members hold now, and every
document asks for the label that most of its neighbours hold (ties go by the hub's
hash, so that neighbours agree), among shards that take documents. What each shard asks of each
other is a table of shards**2 numbers; the driver scales it until no shard gets more than its
quota and what leaves it, and that share of those who ask moves: small groups as a whole, by
the hub's hash, members of large ones one by one. A shard that is full and gives nothing up is
closed, so a group larger than a quota goes on to the next label. Rounds end when few move.

The law is ``rows``. Documents without links take no part; they fill what linked ones
leave of each quota, and so do linked ones beyond their shard's quota. All are ranked
by counts of (label, bucket) and row numbers within buckets.

A hub of at least 1/4096 of all rows is dealt over several keys in joins and buckets; there
are at most 4,096 such hubs, which bounds what is collected and broadcast. Counts are
made on the map side first. Null texts have size 1 and checksum 0 and no link of their
own; empty texts are equal to each other. A null id is hashed as such. Repeated rows are
equal texts. Salts, labels and slots depend on rows alone, not on how they are partitioned, so reruns and tasks that are made again agree. Fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.store import Shelf, hot, settle

MOST, ROUNDS, FEW = 32768, 12, 0.0005


def _salted(edges: DataFrame, counts: DataFrame, heavy: DataFrame) -> DataFrame:
    """The rows of ``edges`` whose hub is linked, with salt and big (whether the hub is heavy)."""
    large = edges.join(heavy, "hub").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.col("salts")).cast("int")).withColumn("big", F.lit(True)).drop("salts")
    small = edges.join(heavy.select("hub"), "hub", "left_anti").join(counts.select("hub"), "hub").withColumn("salt", F.lit(0)).withColumn("big", F.lit(False))
    return large.unionByName(small)


def _votes(edges: DataFrame, heavy: DataFrame, shards: int) -> DataFrame:
    """(hub, salt, v): how many members hold each label, for every salt of the hub."""
    held = edges.groupBy("hub").agg(F.array(*[F.count_if(F.col("label") == s) for s in range(shards)]).alias("v"))
    return held.join(heavy, "hub", "left").select("hub", "v", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))


def _asked(nodes: DataFrame, edges: DataFrame | None, heavy: DataFrame, shards: int, taking: list[bool]) -> DataFrame:
    """The nodes with ``want``: the label that most neighbours hold now, among those that take documents and the own one."""
    if edges is None:
        heard = nodes.join(_votes(nodes, heavy, shards), ["hub", "salt"]).withColumn("seed", F.col("hub"))
    else:
        now = edges.join(nodes.select("node", "label").distinct(), "node")
        told = now.join(_votes(now, heavy, shards), ["hub", "salt"])
        told = told.groupBy("node").agg(F.array(*[F.sum(F.get("v", F.lit(s))) for s in range(shards)]).alias("v"), F.min("hub").alias("seed"))
        heard = nodes.join(told, "node")
    opens = ", ".join(str(x).lower() for x in taking)
    best = f"array_min(transform(sequence(0, {shards - 1}), s -> IF(get(array({opens}), s) OR s = label, struct(-v[s] AS a, pmod(xxhash64(seed, s), 1000003) AS b, s AS s), NULL)))"
    return heard.withColumn("want", F.expr(f"{best}.s")).drop("v", "seed")


def shares(flows: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The share of each flow (from, to) that may move, so that no label gains more than its room."""
    x = flows.astype(float)
    for _ in range(100):
        into, out = x.sum(axis=0), x.sum(axis=1)
        part = np.where(into > 0, np.clip((room + out) / np.maximum(into, 1e-9), 0, 1), 1.0)
        if (part > 1 - 1e-6).all():
            break
        x *= part[None, :]
    return x / np.maximum(flows, 1)


def _unit(*of: Column) -> Column:
    """A hash of the columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def propagated(nodes: DataFrame, edges: DataFrame | None, heavy: DataFrame, shards: int, share: float, shelf: Shelf, rounds: int = ROUNDS) -> DataFrame:
    """The nodes (node, hub, salt, big, label and others) with their last label. edges: (node, hub, salt), or None where each node's own hub is its only one."""
    taking, n = [True] * shards, None
    unit = F.xxhash64("node") if edges is not None else F.when(F.col("big"), F.col("node")).otherwise(F.col("hub"))
    before = []
    for turn in range(rounds):
        asked = shelf.put(_asked(nodes, edges, heavy, shards, taking))
        flows = np.zeros((shards, shards))
        for r in asked.groupBy("label", "want").count().collect():  # at most shards**2 rows
            flows[r["label"], r["want"]] = r["count"]
        load = flows.sum(axis=1)
        n = n or load.sum()
        np.fill_diagonal(flows, 0)
        part = shares(flows, share - load)
        into = (flows * part).sum(axis=0)
        limit = F.element_at(F.array(*[F.lit(float(p)) for p in part.reshape(-1)]), (F.col("label") * shards + F.col("want") + 1).cast("int"))
        moves = (F.col("label") != F.col("want")) & (_unit(unit, F.lit(turn)) < limit)
        nodes = asked.withColumn("label", F.when(moves, F.col("want")).otherwise(F.col("label"))).drop("want")
        shelf.drop(*before)
        before = [asked]
        full = (load + into >= 0.98 * share) & (flows.sum(axis=0) > 0) & (into < 0.05 * flows.sum(axis=0))
        closed = [(load[s] + into[s] >= 0.95 * share and not taking[s]) or bool(full[s]) for s in range(shards)]
        changed, taking = [not c for c in closed] != taking, [not c for c in closed]
        if into.sum() <= FEW * n and not changed:
            break
    return nodes


def shard(docs: DataFrame, shards: int = 16, links: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``. links: further (doc_id, hub), hub of any type."""
    text, shelf = F.col("text"), Shelf(docs.sparkSession)
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("hub"))
    rows = shelf.put(rows.withColumn("node", F.xxhash64("doc_id", "hub", "size")))
    n = rows.count()
    sizes = shelf.put(rows.where("hub IS NOT NULL").groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"))
    heavy = hot(sizes, ["hub"], n)
    base = _salted(rows.where("hub IS NOT NULL"), sizes, heavy)
    edges = None
    if links is not None:
        more = links.where("hub IS NOT NULL").select("doc_id", F.xxhash64(F.lit("link"), "hub").alias("hub"))
        pairs = shelf.put(rows.where("hub IS NOT NULL").select("node", "hub").join(sizes.select("hub"), "hub").union(rows.select("doc_id", "node").join(more, "doc_id").select("hub", "node")).distinct())
        counts = shelf.put(pairs.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"))
        heavy = hot(counts, ["hub"], n)
        edges = shelf.put(_salted(pairs, counts, heavy).drop("big"))
        base = rows.join(edges.select("node").distinct(), "node", "left_semi").withColumn("salt", F.lit(0)).withColumn("big", F.lit(False))
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    linked = shelf.put(base.withColumn("label", start))
    columns = ["doc_id", "size", "text_crc32", "hub", "node", "salt", "label"]
    settled = propagated(linked, edges, heavy, shards, n / shards, shelf, rounds).select(*columns)
    # those without links: by hub, so that no repeated row is taken for a linked one
    single = rows.where("hub IS NOT NULL").join(heavy.select("hub"), "hub", "left_anti").join(sizes.select("hub"), "hub", "left_anti").unionByName(rows.where("hub IS NULL"))
    if edges is not None:
        single = rows.join(edges.select("node").distinct(), "node", "left_anti")
    k = max(4, min(MOST, n // (shards * 4096)))  # buckets of a label; those without one are as many as all others may be
    named = settled.unionByName(single.withColumn("salt", F.lit(0)).withColumn("label", F.lit(-1)).select(*columns))
    bucket = F.pmod(F.when(F.col("label") >= 0, F.xxhash64("hub", "salt")).otherwise(F.xxhash64("node", F.lit(5))), F.when(F.col("label") >= 0, F.lit(k)).otherwise(F.lit(k * shards)))
    made = settle(named.select("doc_id", "size", "text_crc32", "hub", "label", bucket.alias("bucket")))
    shelf.drop(*shelf.paths.values())
    return _cut(made, n, shards)


def _cut(named: DataFrame, n: int, shards: int) -> DataFrame:
    """The rows with their shards and slots: labels as far as quotas go, the others where room is left."""
    counts = settle(named.groupBy("label", "bucket").count())
    load = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("count").alias("n")).collect()}  # a row a label
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    kept = [min(q, load.get(s, 0)) for s, q in enumerate(quota)]
    over = [load.get(s, 0) - k for s, k in enumerate(kept)]
    first = [load.get(-1, 0) + sum(over[:s]) for s in range(shards)]  # places of those beyond the quota among the loose ones
    room = np.concatenate([[0], np.cumsum([q - k for q, k in zip(quota, kept, strict=True)])]).tolist()
    array = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    at = lambda values, i: F.get(array(values), i)
    before = F.sum("count").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    within = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("hub", "text_crc32", "doc_id", "size"))
    # at most 2 * shards * MOST counts
    ranked = named.join(F.broadcast(counts.select("label", "bucket", F.coalesce(before, F.lit(0)).alias("before"))), ["label", "bucket"]).withColumn("rank", F.col("before") + within - 1)
    stays = (F.col("label") >= 0) & (F.col("rank") < at(quota, F.col("label")))
    loose = F.when(F.col("label") < 0, F.col("rank")).otherwise(at(first, F.col("label")) + F.col("rank") - at(quota, F.col("label")))
    ranked = ranked.withColumn("loose", F.when(~stays, loose))
    dealt = F.size(F.filter(array(room[1:]), lambda c: c <= F.col("loose")))
    ranked = ranked.withColumn("shard", F.when(stays, F.col("label")).otherwise(dealt).cast("int"))
    slot = F.when(stays, F.col("rank")).otherwise(at(kept, F.col("shard")) + F.col("loose") - at(room, F.col("shard")))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
