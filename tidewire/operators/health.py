"""Health of sources and of the backlog, as one job for all sources. Each takes an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.operators.articles import SUCCESSFUL, TERMINAL


def extraction_rates(articles: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(source, attempted, successful, rate) over articles (source, status, ingested) of the last ``hours``."""
    rows = articles.where((F.col("ingested") >= as_of - F.expr(f"INTERVAL {hours} HOUR")) & (F.col("ingested") <= as_of))
    made = rows.groupBy("source").agg(F.count_if(F.col("status").isin(*TERMINAL)).alias("attempted"), F.count_if(F.col("status").isin(*SUCCESSFUL)).alias("successful"))
    return made.withColumn("rate", F.round(F.try_divide("successful", "attempted"), 4))


def latencies(articles: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(source, minutes): mean time from publication (published) to ingestion over the last ``hours``."""
    rows = articles.where((F.col("ingested") >= as_of - F.expr(f"INTERVAL {hours} HOUR")) & (F.col("ingested") <= as_of) & F.col("published").isNotNull())
    return rows.groupBy("source").agg(F.round(F.avg((F.unix_micros("ingested") - F.unix_micros("published")) / 6e7), 4).alias("minutes"))


def backlog(articles: DataFrame, as_of: Column) -> DataFrame:
    """One row: pending articles, the age of the oldest in seconds, articles processed in the last hour, and their mean seconds (processed boolean, ingested, processed_at, seconds)."""
    open_, hour = ~F.col("processed"), F.coalesce(F.col("processed") & (F.col("processed_at") >= as_of - F.expr("INTERVAL 1 HOUR")), F.lit(False))
    age = (F.unix_micros(as_of) - F.unix_micros(F.min(F.when(open_, F.col("ingested"))))) / 1e6
    return articles.agg(F.count_if(open_).alias("pending"), F.greatest(F.lit(0.0), age).alias("oldest_seconds"), F.count_if(hour).alias("last_hour"), F.round(F.avg(F.when(hour, F.col("seconds"))), 3).alias("mean_seconds"))


def refreshed(sources: DataFrame, runs: DataFrame, articles: DataFrame, deviations: DataFrame, as_of: Column) -> DataFrame:
    """Health of every source and its next interval: (source, health, reasons, staleness, interval).

    sources (source, key, interval, base), runs as run_health makes them, with recent_4xx; articles (source, status, ingested, published); deviations (source, items_dev, duplicate_dev).
    """
    newest = articles.groupBy("source").agg(F.max("published").alias("latest"))
    rows = sources.join(runs, "source", "left").join(extraction_rates(articles, as_of).select("source", "rate"), "source", "left").join(newest, "source", "left").join(deviations, "source", "left")
    stale = S.staleness(F.col("latest"), as_of, S.expected_staleness(F.col("key"), F.col("interval")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    status, reasons = S.health(zero("failures"), F.col("parse_rate"), F.col("rate"), stale, F.coalesce("recent_4xx", F.lit(False)), zero("errors"), zero("skips"), F.col("items_dev"), F.col("duplicate_dev"))
    return rows.select("source", status.alias("health"), F.array_join(reasons, ",").alias("reasons"), F.round(stale, 4).alias("staleness"), S.next_interval(status, zero("streak"), F.col("interval"), F.col("base")).alias("interval"))
