"""Streaming twins. Each has a batch form with the same rows, which is the one to trust when they differ."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "48 hours") -> DataFrame:
    """One row a key within the watermark. The reference drops nothing as late, so the delay is wide and a batch run fills in."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def rate_windows(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(user_id, minute, n, limited) by fixed windows: the same plan over a batch and, with a watermark, over a stream."""
    w = events.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.floor(F.unix_seconds("w.start") / seconds).alias("minute"), "n", (F.col("n") > limit).alias("limited"))


def cooled_down(alerts: DataFrame, minutes: int = 30) -> DataFrame:
    """Alerts (key, ts, ...) without those within ``minutes`` of the last one that passed, by key: state is one timestamp, which expires ``minutes`` after the stream's clock has passed it."""
    schema = alerts.schema
    span = minutes * 60_000

    def fold(key, frames: Iterator, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        at = rows["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
        kept, i = [], 0 if last is None else int(np.searchsorted(at, last + span))
        while i < len(at):
            kept.append(i)
            last = int(at[i])
            i = int(np.searchsorted(at, last + span))
        state.update((last,))
        state.setTimeoutDuration(span)
        yield rows.iloc[kept]

    return alerts.groupBy("key").applyInPandasWithState(fold, schema, "last long", "append", "ProcessingTimeTimeout")


def ewma(events: DataFrame, alpha: float = 0.25, start: float = 0.5, stored: DataFrame | None = None, idle_hours: int | None = None) -> DataFrame:
    """(user_id, key, weight) after each micro-batch, from (user_id, key, ts, seq, signal); the state is the weight.

    With ``idle_hours`` state goes that long (of the stream's clock) after a key's last event; ``stored`` (user_id, key, weight), where earlier results lie, is what a
    key without state goes on from, so nothing is forgotten. Without both, state stays.
    """
    rows = events.withColumn("_from", F.lit(None).cast("double"))
    if stored is not None:
        rows = events.join(stored.select("user_id", "key", F.col("weight").alias("_from")), ["user_id", "key"], "left")

    def fold(key, frames: Iterator, state):
        import math

        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        weight = state.get[0] if state.exists else None
        for pdf in frames:
            if weight is None:
                first = pdf["_from"].iloc[0]
                weight = start if pd.isna(first) else float(first)
            for s in pdf.sort_values(["ts", "seq"])["signal"]:
                target = min(1.0, max(0.0, (s + 1) / 2))
                weight = math.floor(min(1.0, max(0.0, (1 - alpha) * weight + alpha * target)) * 10000 + 0.5) / 10000  # as the batch form
        state.update((weight,))
        if idle_hours:
            state.setTimeoutDuration(idle_hours * 3_600_000)
        yield pd.DataFrame([(*key, weight)], columns=["user_id", "key", "weight"])

    return rows.groupBy("user_id", "key").applyInPandasWithState(fold, "user_id long, key long, weight double", "weight double", "update", "ProcessingTimeTimeout" if idle_hours else "NoTimeout")


def seen_items(events: DataFrame, most: int = 20, window: int = 200, hours: int = 24) -> DataFrame:
    """(user_id, news_ids, expired): each user's last ``most`` different items of the last ``window`` events, newest first, whenever they change, from (user_id, news_id, ts, seq) with a watermark on ``ts``.

    State is that list of events. It goes when the watermark passes the last of them by ``hours``, and a row with an empty list tells so. The batch form is ``personal.recent_unique`` with ``as_of``.
    """
    span = hours * 3_600_000

    def fold(key, frames: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "news_ids": [[]], "expired": [True]})
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in frames:
            held += zip(pdf["ts"].astype("datetime64[ms]").astype("int64").tolist(), pdf["seq"].tolist(), pdf["news_id"].tolist(), strict=True)
            held = sorted(held, key=lambda e: (e[1], e[0]), reverse=True)[:window]
        state.update(tuple(list(x) for x in zip(*held, strict=True)))
        state.setTimeoutTimestamp(max(max(e[0] for e in held) + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "news_ids": [list(dict.fromkeys(e[2] for e in held))[:most]], "expired": [False]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, news_ids array<long>, expired boolean", "at array<long>, seq array<long>, id array<long>", "update", "EventTimeTimeout")


def trusted(rows: DataFrame, ts: str, inferred: str, now: str) -> Column:
    """Whether a row's event time may move a clock: it was stated, not inferred, and doesn't lie after the row came in."""
    return F.col(ts).isNotNull() & ~F.coalesce(F.col(inferred), F.lit(False)) & (F.col(ts) <= F.col(now))


def counted_by_window(stream: DataFrame, folder: str, checkpoint: str, key: str, ts: str = "ts", inferred: str = "inferred", now: str = "came", window: str = "1 hour", delay_hours: int = 48):
    """Counts by window and key that drop nothing: a running query that writes each micro-batch's counts under ``folder``, on time or as backfill.

    The clock is the latest trusted time of the micro-batches before, less ``delay_hours``; times that were inferred or lie ahead never move it. Rows behind the clock, and rows
    with such times, are counted as backfill. A micro-batch that is run again overwrites its own files, so each row counts once. ``window_counts`` reads both.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_trusted", trusted(batch, ts, inferred, now)).persist()
        marks = f"{folder}/marks"
        before = None
        if number and _there(spark, marks):
            before = spark.read.parquet(marks).where(F.col("batch") < number).agg(F.max("latest")).first()[0]
        clock = F.lit(before).cast("timestamp") - F.make_dt_interval(hours=F.lit(delay_hours))
        late = ~F.col("_trusted") | F.coalesce(F.col(ts) < clock, F.lit(False))
        counts = batch.groupBy(F.window(ts, window).start.alias("window"), key, late.alias("backfill")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")
        batch.agg(F.max(F.when(F.col("_trusted"), F.col(ts))).alias("latest")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """(window, key, n, late): what ``counted_by_window`` has counted so far, and how many of them came as backfill."""
    rows = spark.read.parquet(f"{folder}/counts")
    return rows.groupBy("window", key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("backfill"), F.col("n")).otherwise(0)).alias("late"))


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def publish(stream: DataFrame, channel: str, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Each micro-batch as JSON messages (channel, message) to a sink."""
    made = stream.select(F.lit(channel).alias("channel"), F.to_json(F.struct("*")).alias("message"))
    return made.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
