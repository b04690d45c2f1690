"""Dated facts: entity profiles and trends, run health, audits, dashboards. All take an explicit ``as_of``; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import scores as S


def entity_profiles(mentions: DataFrame, as_of: Column, baseline_days: int = 30) -> DataFrame:
    """(entity, current, baseline, sources, trend) from (entity, source, n, ts): the last day against the daily mean of the 30 before, in one pass."""
    end = as_of - F.expr("INTERVAL 1 DAY")
    start = end - F.expr(f"INTERVAL {baseline_days} DAY")
    now, before = F.col("ts") >= end, (F.col("ts") >= start) & (F.col("ts") < end)
    rows = mentions.where((F.col("ts") >= start) & (F.col("ts") < as_of))
    made = rows.groupBy("entity").agg(
        F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).cast("double").alias("current"),
        F.round(F.coalesce(F.sum(F.when(before, F.col("n"))), F.lit(0)) / float(baseline_days), 4).alias("baseline"),
        F.countDistinct(F.when(now, F.col("source"))).alias("sources"))
    return made.withColumn("trend", S.trend(F.col("current"), F.col("baseline"), F.col("sources")))


def rising(profiles: DataFrame, factor: float) -> DataFrame:
    """Entities whose current rate is over ``factor`` times the baseline, largest difference first."""
    return profiles.where(F.col("current") > factor * F.col("baseline")).withColumn("gain", F.round(F.col("current") - F.col("baseline"), 4)).orderBy(F.desc("gain"), "entity")


def run_health(runs: DataFrame, last: int = 10, neutral: tuple[str, ...] = ("skipped",), success: str = "success") -> DataFrame:
    """(source, runs, parse_rate, errors, skips, streak, failures) over each source's ``last`` runs (source, run, ts, status, errors).

    Neutral runs count in no rate, break a success streak, and neither break nor count in a row of failures.
    """
    newest = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("run"))
    rows = runs.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)
    good, idle = F.col("status") == success, F.col("status").isin(*neutral)
    first_good = F.min(F.when(good, F.col("rn"))).over(Window.partitionBy("source"))
    first_other = F.min(F.when(~good, F.col("rn"))).over(Window.partitionBy("source"))
    rows = rows.withColumn("first_good", first_good).withColumn("first_other", first_other)
    return rows.groupBy("source").agg(
        F.count("*").alias("runs"),
        (F.count_if(good) / F.nullif(F.count_if(~idle), F.lit(0))).alias("parse_rate"),
        F.sum("errors").alias("errors"), F.count_if(idle).alias("skips"),
        F.coalesce(F.max("first_other") - 1, F.count("*")).cast("long").alias("streak"),
        F.count_if(~good & ~idle & (F.col("first_good").isNull() | (F.col("rn") < F.col("first_good")))).alias("failures"))


def median_deviation(daily: DataFrame, last: int = 30) -> DataFrame:
    """(source, latest, median, deviation): the newest value against the median of up to ``last`` - 1 before it, relative to that."""
    newest = Window.partitionBy("source").orderBy(F.desc("day"))
    rows = daily.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)
    made = rows.groupBy("source").agg(F.max(F.when(F.col("rn") == 1, F.col("value"))).cast("double").alias("latest"), F.median(F.when(F.col("rn") > 1, F.col("value"))).alias("median"))
    return made.withColumn("deviation", F.round(F.try_divide(F.col("latest") - F.col("median"), F.nullif(F.col("median"), F.lit(0.0))), 6))


def date_audit(items: DataFrame, as_of: Column) -> DataFrame:
    """Dates by source over the day before ``as_of``: (source, published, ingested, inferred)."""
    rows = items.where((F.col("ingested") > as_of - F.expr("INTERVAL 1 DAY")) & (F.col("ingested") <= as_of))
    behind = (F.unix_micros("ingested") - F.unix_micros("published")) / 3.6e9
    made = rows.groupBy("source").agg(
        F.count("*").alias("items"), F.min("published").alias("oldest"), F.max("published").alias("newest"),
        F.round(F.avg(behind)).cast("long").alias("hours_behind"), F.count_if(F.col("published") > F.col("ingested")).alias("items_in_future"),
        F.count_if("inferred").alias("items_inferred"), F.round(F.count_if("inferred") / F.nullif(F.count("*"), F.lit(0)), 3).alias("inferred_ratio"))
    return made.withColumn("flag", F.when(F.col("items_in_future") > 0, "high").when(F.col("inferred_ratio") > 0.10, "medium").otherwise("ok"))


def source_utility(items: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(source, items, unique_items, utility): share of a source's recent items whose cluster no other source has.

    A cluster's sources are counted once over all history and joined back; an item without a cluster is unique.
    """
    several = items.where("cluster IS NOT NULL").groupBy("cluster").agg(F.countDistinct("source").alias("sources"))
    recent = items.where((F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAY")) & (F.col("ts") < as_of))
    rows = recent.join(several, "cluster", "left")
    unique = F.count_if(F.coalesce("sources", F.lit(1)) <= 1)
    return rows.groupBy("source").agg(F.count("*").alias("items"), unique.alias("unique_items"), F.round(unique / F.count("*"), 4).alias("utility"))


def conditional_counts(facts: DataFrame, key: str, kinds: dict[str, Column]) -> DataFrame:
    """One row a key, one count a condition, in one pass."""
    return facts.groupBy(key).agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))


def cluster_labels(edges: DataFrame, nodes: DataFrame, scratch) -> DataFrame:
    """(id, cluster): the smallest id that edges (u, v) reach. Each round's tables (``scratch``) are deleted after the next.

    In each round every cluster joins the smallest one beside it, and edges are those between what is left: edges within a cluster go,
    several between two are one. Two rounds halve the clusters that have edges at least (one that nobody joined has a smaller one beside it after a round), and the first round's edges are read by it alone.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    edges = scratch.put(edges.where("u <> v").select(u.alias("u"), v.alias("v")).distinct())
    at = scratch.put(nodes.select("id", F.col("id").alias("cluster")))
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = scratch.put(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("key"), F.least("u", "v").alias("up"), F.lit(True).alias("moved")))
        while True:  # to the end of each path, by doubling
            above = up.select(F.col("key").alias("up"), F.col("up").alias("_next"))
            step = scratch.put(up.join(above, "up", "left").select("key", F.coalesce("_next", "up").alias("up"), (F.coalesce("_next", "up") != F.col("up")).alias("moved")))
            more = step.where("moved").limit(1).count()
            scratch.drop(up)
            up = step
            if not more:
                break
        root = lambda c: up.select(F.col("key").alias(c), F.col("up").alias(f"_{c}"))
        now = scratch.put(at.join(root("cluster"), "cluster", "left").select("id", F.coalesce("_cluster", "cluster").alias("cluster")))
        left = edges.join(root("u"), "u").join(root("v"), "v").where("_u <> _v").select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct()
        left = scratch.put(left)
        scratch.drop(at, edges, up)
        at, edges = now, left
    return at
