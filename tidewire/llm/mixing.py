"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations alone.

Sources in code-point order, null last, take the weights in turn. They share
``share`` times all words in proportion to these; no target passes ``most`` times its
source's words, and what is left over is shared again among the others by weight.
That is one level: each target is min(most * words, weight * level), found from
running sums over the sources ordered by most * words / weight.

A target is met by whole passes over a source and, for the rest, by the documents
whose hash is below a threshold. The threshold comes from histograms of words by
source and hash bucket: the bucket in which the budget ends is split into 4,096 again,
``LEVELS`` times, and only its rows are read for that. No row is sorted. A larger
budget has a larger threshold, so what a small mix takes a large one takes too. Rows
whose 48 hash bits are the same (the rows of one id) are taken or left together,
whichever comes nearer to the target.

The hash is of doc_id alone: reruns and other partitionings take the same rows. A
null or empty text has size 0 and takes no words; a null id is hashed as an empty one.
Repeated rows count as often as they stand. A source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.store import settle

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
LEVELS, STEP = 4, 12
FEW_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """48 hash bits of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source. The sources' sums, not documents, meet in one task."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = by_source.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = whole.orderBy("full_at", "turn")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(whole)
    rows = rows.withColumn("level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    rows = rows.withColumn("step", F.row_number().over(order))
    level = F.min_by("level", F.when(F.col("full_at") >= F.col("level"), F.col("step"))).over(whole)
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _with(rows: DataFrame, per_source: DataFrame, few: bool, *also: Column) -> DataFrame:
    """Inner join by source (null meets null). The side with one row a source is broadcast while it is small; else skewed sources are split at run time."""
    right = per_source.withColumnRenamed("source", "source_")
    on = F.col("source").eqNullSafe(F.col("source_"))
    for x in also:
        on = on & x
    return rows.join(F.broadcast(right) if few else right, on).drop("source_")


def thresholds(sizes: DataFrame, **how) -> tuple[DataFrame, bool]:
    """(source, source_size, target, passes, below) from (source, size, place): a row is taken ``passes`` times, and once more if its place is under ``below``. Also whether there are few sources."""
    goal = targets(sizes, **how).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = settle(goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    few = goal.count() <= FEW_SOURCES
    bits = LEVELS * STEP
    at = goal.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"))
    for level in range(1, LEVELS + 1):
        shift = bits - level * STEP
        inside = _with(sizes.where("size > 0"), at, few, *([F.shiftright("place", shift + STEP) == F.col("prefix")] if level > 1 else []))
        hist = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("under").alias("under"))
        run = F.col("under") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        end = hist.withColumn("upto", run).where("upto > rest").groupBy("source").agg(F.min_by(F.struct("rest", "bucket", "words", "upto"), "bucket").alias("b"))
        end = end.select("source", "b.rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.words")).alias("under"), F.col("b.upto").alias("upto"))
        at = settle(end)
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("under")
    ends = at.select("source", (F.col("prefix") + nearer.cast("long")).alias("below"))
    right = ends.withColumnRenamed("source", "source_")
    made = goal.join(right, F.col("source").eqNullSafe(F.col("source_")), "left").select("source", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below"))
    return made, few


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs``."""
    sizes = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place")))
    ends, few = thresholds(sizes, **how)
    copies = F.col("passes") + (F.col("place") < F.col("below")).cast("long")
    rows = _with(sizes, ends, few).withColumn("copies", copies)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it. A row that has no words stays once: it costs no budget."""
    keyed = docs.select(F.struct("*").alias("row"), "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place"))
    ends, few = thresholds(settle(keyed.select("source", "size", "place")), **how)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("passes") + (F.col("place") < F.col("below")).cast("long"))
    rows = _with(keyed, ends, few).select("row", copies.alias("copies")).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
t AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, CAST([3, 1, 2][turn % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM t),
r AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(weight) OVER (ORDER BY full_at, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY full_at, turn) AS step FROM r),
f AS (SELECT arg_min(level, step) AS level FROM l WHERE full_at >= level),
g AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM f)) AS target FROM r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM g),
h AS (SELECT source, place, sum(size) AS words FROM d GROUP BY source, place),
c AS (SELECT h.source, place, words, sum(words) OVER (PARTITION BY h.source ORDER BY place) AS upto, target - passes * source_size AS rest
      FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source),
k AS (SELECT source, place, CASE WHEN upto <= rest THEN 1 WHEN upto - words <= rest AND upto - rest < rest - (upto - words) THEN 1 ELSE 0 END AS more FROM c)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST((p.passes + k.more) * d.size AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.place = k.place
"""
