"""Profiles learnt from interactions, personal ranking, diversity, digests and alerts.

What is sequential by nature (caps, fills, running averages with rounding at each step) is a
fold over an ordered array: it runs inside the JVM, one row a user or query, whose
length the operator bounds or the user's own history does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators.retrieval import ranked


def ewma_weights(events: DataFrame, alpha: float = 0.25, start: float = 0.5, explicit: DataFrame | None = None) -> DataFrame:
    """(user_id, key, weight) from (user_id, key, ts, seq, signal): the weight after each event in order, rounded at each step. Explicit keys (user_id, key) aren't learnt."""
    rows = events if explicit is None else events.join(explicit.select("user_id", "key"), ["user_id", "key"], "left_anti")
    steps = rows.groupBy("user_id", "key").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "signal"))).alias("steps"))
    return steps.select("user_id", "key", F.aggregate("steps", F.lit(start), lambda w, e: S.ewma_step(w, e["signal"], alpha)).alias("weight"))


def centroids(actions: DataFrame, vectors: DataFrame, most: int = 50) -> DataFrame:
    """(user_id, vector): weighted mean of the vectors of each user's ``most`` latest positive articles (user_id, news_id, ts, seq, weight), one action an article."""
    latest = ranked(actions, ["user_id", "news_id"], [F.desc("ts"), F.desc("seq")], 1, "_r").drop("_r").where("weight > 0")
    recent = ranked(latest, ["user_id"], [F.desc("ts"), F.desc("seq")], most, "_r")
    parts = recent.join(vectors, "news_id").select("user_id", "weight", F.posexplode("vector").alias("pos", "x"))
    mean = parts.groupBy("user_id", "pos").agg((F.sum(F.col("weight") * F.col("x").cast("double")) / F.sum("weight")).alias("m"))
    return mean.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))


def recent_unique(events: DataFrame, most: int = 20, window: int | None = None, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    """(user_id, news_id, rank): each user's most recent different items (user_id, news_id, seq), within the last ``window`` events if set. With ``as_of``, users (ts) without an event in the ``hours`` before have none."""
    if as_of is not None:
        active = events.where(F.col("ts") > as_of - F.make_dt_interval(hours=F.lit(hours))).select("user_id").distinct()
        events = events.join(active, "user_id", "left_semi")
    rows = events if window is None else ranked(events, ["user_id"], [F.desc("seq")], window, "_r").drop("_r")
    last = rows.groupBy("user_id", "news_id").agg(F.max("seq").alias("seq"))
    return ranked(last, ["user_id"], [F.desc("seq")], most)


_ITEM = "struct<at: long, id: long, source: long, topics: array<string>, score: double>"


def _lists(results: DataFrame) -> DataFrame:
    """(key, items): each key's results in rank order."""
    item = F.struct(F.col("rank").alias("at"), F.col("news_id").alias("id"), F.col("source_id").alias("source"), "topics", F.col("score"))
    return results.groupBy("key").agg(F.array_sort(F.collect_list(item)).cast(f"array<{_ITEM}>").alias("items"))


def _held(list_: Column, value: Column) -> Column:
    return F.size(F.filter(list_, lambda x: x == value))


def capped(results: DataFrame, topic_cap: int = 3, source_cap: int = 3) -> DataFrame:
    """(key, position, news_id, deferred): results in order, those over a source or topic cap put behind the others.

    Results: (key, rank, news_id, source_id, topics, score).
    """
    start = F.struct(F.array().cast("array<long>").alias("sources"), F.array().cast("array<string>").alias("topics"), F.array().cast("array<struct<id: long, late: boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        late = (_held(s["sources"], x["source"]) >= source_cap) | F.exists(F.coalesce(x["topics"], F.array().cast("array<string>")), lambda t: _held(s["topics"], t) >= topic_cap)
        return F.struct(
            F.when(late, s["sources"]).otherwise(F.concat(s["sources"], F.array(x["source"]))).alias("sources"),
            F.when(late, s["topics"]).otherwise(F.concat(s["topics"], F.coalesce(x["topics"], F.array().cast("array<string>")))).alias("topics"),
            F.concat(s["out"], F.array(F.struct(x["id"].alias("id"), late.alias("late")))).alias("out"))

    done = _lists(results).select("key", F.aggregate("items", start, step).alias("s"))
    order = F.concat(F.filter("s.out", lambda x: ~x["late"]), F.filter("s.out", lambda x: x["late"]))
    rows = done.select("key", F.posexplode(order).alias("position", "x"))
    return rows.select("key", (F.col("position") + 1).cast("long").alias("position"), F.col("x.id").alias("news_id"), F.col("x.late").alias("deferred"))


def diversified(results: DataFrame, slider: float, window: int = 10, drop: float = 0.015) -> DataFrame:
    """(key, position, news_id): caps by the slider, then, from 0.35, the first fresh result of the window promoted to place 2 if it costs little score."""
    cap = 3 if max(0.0, min(1.0, slider)) < 0.4 else 2
    order = capped(results, cap, cap)
    if slider < 0.35:
        return order.drop("deferred")
    rows = order.join(results.select("key", "news_id", "source_id", "topics", "score"), ["key", "news_id"])
    w = Window.partitionBy("key").orderBy("position")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    seen = F.flatten(F.collect_list(topics).over(before))
    fresh = ~F.array_contains(F.collect_list("source_id").over(before), F.col("source_id")) | (F.size(topics) == 0) | (F.size(F.array_except(topics, seen)) > 0)
    rows = rows.withColumn("fresh", (F.col("position") > 1) & (F.col("position") <= window) & fresh)
    all_ = Window.partitionBy("key")
    rows = rows.withColumn("first", F.min(F.when(F.col("fresh"), F.col("position"))).over(all_)).withColumn("top", F.max(F.when(F.col("position") == 1, F.col("score"))).over(all_)).withColumn("own", F.max(F.when(F.col("position") == F.col("first"), F.col("score"))).over(all_)).withColumn("n", F.count("*").over(all_))
    move = F.coalesce((F.col("n") >= 3) & (F.col("first") > 2) & (F.col("top") - F.col("own") <= drop), F.lit(False))
    place = F.when(move & (F.col("position") == F.col("first")), 2).when(move & F.col("position").between(2, F.col("first") - 1), F.col("position") + 1).otherwise(F.col("position"))
    return rows.select("key", place.cast("long").alias("position"), "news_id")


def digest(results: DataFrame, limit: int, previous: DataFrame | None = None) -> DataFrame:
    """(key, position, news_id, fallback): a shortlist under a topic cap without what was sent before, filled up with any others in order.

    The fill does not look at what was sent before, as in the behaviour re-expressed.
    """
    cap = max(2, min(6, limit // 8 + 1))
    sent = previous.groupBy("key").agg(F.collect_set("news_id").alias("sent")) if previous is not None else None
    lists = _lists(results)
    lists = lists.join(sent, "key", "left") if sent is not None else lists.withColumn("sent", F.lit(None).cast("array<long>"))
    lists = lists.withColumn("sent", F.coalesce("sent", F.array().cast("array<long>")))
    start = F.struct(F.array().cast("array<string>").alias("topics"), F.array().cast("array<long>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        topics = F.coalesce(x["topics"], F.array().cast("array<string>"))
        no = (F.size(s["out"]) >= limit) | F.array_contains("sent", x["id"]) | F.exists(topics, lambda t: _held(s["topics"], t) >= cap)
        return F.struct(F.when(no, s["topics"]).otherwise(F.concat(s["topics"], topics)).alias("topics"), F.when(no, s["out"]).otherwise(F.concat(s["out"], F.array(x["id"]))).alias("out"))

    done = lists.select("key", "items", F.aggregate("items", start, step)["out"].alias("main"))
    rest = F.filter(F.transform("items", lambda x: x["id"]), lambda i: ~F.array_contains("main", i))
    fill = F.slice(F.array_distinct(rest), F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.size("main")))
    rows = done.select("key", F.posexplode(F.concat(F.transform("main", lambda i: F.struct(i.alias("id"), F.lit(False).alias("fallback"))), F.transform(fill, lambda i: F.struct(i.alias("id"), F.lit(True).alias("fallback"))))).alias("p", "x"))
    return rows.select("key", (F.col("p") + 1).cast("long").alias("position"), F.col("x.id").alias("news_id"), F.col("x.fallback").alias("fallback"))


def digest_hashes(items: DataFrame, kind: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "news_id"))), lambda x: x["news_id"])
    return items.groupBy("key").agg(T.content_hash(F.lit(kind), ids).alias("content_hash"), F.count("*").alias("items"))


#: Scores of the kinds of alert.
ALERT_SCORES = {"keyword_match": 0.82, "alert_news": 0.9, "spike": 0.85, "breaking": 0.95, "tracked_topic": 0.8}


def alerts(candidates: list[DataFrame], cooldown: DataFrame | None = None, most: int = 50) -> DataFrame:
    """(user_id, alert_type, news_id, entity_id, topic_id, score, rank) of several kinds: duplicates by key once, without recent (user_id, alert_type, news_id), best first."""
    rows = candidates[0]
    for c in candidates[1:]:
        rows = rows.unionByName(c)
    rows = rows.groupBy("user_id", "alert_type", "news_id", "entity_id", "topic_id").agg(F.max("score").alias("score"))
    if cooldown is not None:
        rows = rows.join(cooldown, ["user_id", "alert_type", "news_id"], "left_anti")
    return ranked(rows, ["user_id"], [F.desc("score"), F.col("alert_type"), F.col("news_id"), F.col("entity_id"), F.col("topic_id")], most)


def dealt_alerts(lists: list[DataFrame], follows: DataFrame, most: int = 50) -> DataFrame:
    """``alerts`` of all that follow (user_id, alert_type, key) lists (alert_type, key, news_id, entity_id, topic_id, score).

    Where a list is longer than ``most``, nobody is shown more than its best ``most`` in the order of alerts, so the others aren't dealt out: rows grow with the followers alone, not with
    followers times news. They stay arrays until only the best ``most`` of all are left.
    """
    keys = ["alert_type", "key"]
    item = ["score", "alert_type", "news_id", "entity_id", "topic_id"]
    rows = lists[0]
    for r in lists[1:]:
        rows = rows.unionByName(r)
    # the best first once sorted; nulls come first, as in ``alerts``
    best = ranked(rows.dropDuplicates([*keys, *item[2:], "score"]), keys, [F.desc("score"), *(F.col(c) for c in item[1:])], most)
    heads = best.groupBy(keys).agg(F.collect_list(F.struct((-F.col("score")).alias("worse"), *(F.col(c) for c in item[1:]))).alias("items"))
    sets = follows.where("key IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_set(F.struct(*keys))).alias("follows"))
    # who follows the same is shown the same: each set's lists are merged once
    each = sets.select("follows").distinct().select("follows", F.inline("follows")).join(heads, keys)
    merged = each.groupBy("follows").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))), 1, most).alias("items"))
    shown = sets.join(merged, "follows").select("user_id", F.posexplode("items").alias("at", "x"))
    return shown.select("user_id", *(f"x.{c}" for c in item[1:]), (-F.col("x.worse")).alias("score"), (F.col("at") + 1).cast("long").alias("rank"))
