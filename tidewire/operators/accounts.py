"""Search logs, stated preferences and cached results: tables that user actions change, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_rows(searches: DataFrame, cut: int = 500, short: int = 40) -> DataFrame:
    """Log rows of (search_id, query, mode, results): texts cut to the log's columns, the results counted."""
    return searches.select("search_id", F.left("query", F.lit(cut)).alias("query"), F.left("mode", F.lit(short)).alias("mode"), F.size("results").cast("long").alias("num_results"), "results")


def clicked(shown: DataFrame, clicks: DataFrame) -> DataFrame:
    """(search_id, news_id, position, score, was_clicked, dwell) of (search_id, news_id, position, score) and (search_id, news_id, at, dwell).

    A click without a result adds one of score 0 and no position; the last stated dwell time counts (of equal times the longest).
    """
    last = clicks.groupBy("search_id", "news_id").agg(F.expr("max_by(dwell, struct(at, dwell)) FILTER (WHERE dwell IS NOT NULL)").alias("dwell"))
    made = shown.join(last.withColumn("was_clicked", F.lit(True)), ["search_id", "news_id"], "full")
    return made.select("search_id", "news_id", "position", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("was_clicked", F.lit(False)).alias("was_clicked"), "dwell")


def replaced_preferences(existing: DataFrame, submitted: DataFrame, users: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preferences (user_id, kind, item_id, weight) after ``users`` (user_id) replaced theirs by ``submitted``, and the submitted rows whose (kind, item_id) isn't ``known``.

    One unknown item refuses all that its user submitted: the user keeps what was there. A user without submitted rows has none afterwards.
    """
    unknown = submitted.join(known.select("kind", "item_id"), ["kind", "item_id"], "left_anti").select(*submitted.columns)
    taken = users.select("user_id").distinct().join(unknown.select("user_id"), "user_id", "left_anti")
    rows = existing.join(taken, "user_id", "left_anti").unionByName(submitted.join(taken, "user_id", "left_semi"))
    return rows, unknown


def live(cache: DataFrame, changes: DataFrame, as_of: Column, kinds: tuple[str, ...] = ("news", "source", "topic")) -> DataFrame:
    """The entries (key, tags array of (kind, value), created, seconds) that are neither too old nor touched by a change (kind, value, at) since. A change of another kind touches all."""
    fresh = cache.where(F.unix_micros(as_of) - F.unix_micros("created") < F.col("seconds").cast("long") * 1_000_000)
    every = changes.agg(F.max(F.when(~F.col("kind").isin(*kinds), F.col("at"))).alias("every"))  # one row
    newest = changes.where(F.col("kind").isin(*kinds)).groupBy("kind", "value").agg(F.max("at").alias("at"))
    tagged = fresh.select("key", "created", F.explode("tags").alias("t")).select("key", "created", F.col("t.kind").alias("kind"), F.col("t.value").alias("value"))
    touched = tagged.join(newest, ["kind", "value"]).where("at >= created").select("key")
    return fresh.join(F.broadcast(every)).where("every IS NULL OR created > every").drop("every").join(touched, "key", "left_anti")
