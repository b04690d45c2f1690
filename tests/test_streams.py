"""Streams with expiring state, late and inferred times, against their batch forms."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.operators import personal
from tidewire.streaming import stateful

START = datetime(2024, 3, 1)


def files(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def test_seen_items_expire(spark, tmp_path):
    schema = "user_id long, news_id long, ts timestamp, seq long"
    rng, seq, batches = random.Random(2), 0, []
    for b in range(5):
        rows = []
        for _ in range(20):
            seq += 1
            rows.append((rng.randrange(4 if b < 3 else 2), rng.randrange(9), START + timedelta(hours=20 * b, minutes=seq), seq))
        batches.append(rows)
    stream = files(spark, f"{tmp_path}/in", batches, schema).withWatermark("ts", "1 hour")
    out = []
    query = stateful.seen_items(stream, 5, 12).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda d, n: out.extend(d.collect())).start()
    query.awaitTermination(200)
    last = {r["user_id"]: list(r["news_ids"]) for r in out}
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    end = max(r[2] for r in batches[-1])
    want = {}
    for r in personal.recent_unique(every, 5, 12, F.lit(end)).orderBy("rank").collect():
        want.setdefault(r["user_id"], []).append(r["news_id"])
    assert {u: n for u, n in last.items() if n} == want and {r["user_id"] for r in out if r["expired"]} == set(last) - set(want) and len(want) == 2


def test_counts_drop_nothing(spark, tmp_path):
    """Shuffled, late, inferred and future times; a run that stops and goes on."""
    schema = "key string, ts timestamp, inferred boolean, came timestamp"
    rng = random.Random(3)
    rows = []
    for i in range(300):
        came = START + timedelta(hours=i)
        late = rng.choice([0, 1, 5, 100, 200])
        inferred = rng.random() < 0.2
        rows.append((rng.choice("ab"), came + timedelta(hours=1000) if inferred and rng.random() < 0.5 else came - timedelta(hours=late), inferred, came))
    batches = [rows[k : k + 60] for k in range(0, 300, 60)]
    folder, check = f"{tmp_path}/out", f"{tmp_path}/c"
    stateful.counted_by_window(files(spark, f"{tmp_path}/in", batches[:3], schema), folder, check, "key").awaitTermination(200)
    for i, b in enumerate(batches[3:], 3):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}.parquet")
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    stateful.counted_by_window(again, folder, check, "key").awaitTermination(200)
    got = {(r["window"], r["key"]): r["n"] for r in stateful.window_counts(spark, folder, "key").collect()}
    want = {}
    for k, ts, *_ in rows:
        at = (ts.replace(minute=0, second=0, microsecond=0), k)
        want[at] = want.get(at, 0) + 1
    assert got == want
    latest = [r[0] for r in spark.read.parquet(f"{folder}/marks").orderBy("batch").select("latest").collect()]
    assert max(latest) <= rows[-1][3]  # no inferred or future time moved the clock
    late = stateful.window_counts(spark, folder, "key").agg(F.sum("late")).first()[0]
    clock, behind = None, 0
    for b in batches:
        behind += sum(1 for _, ts, inferred, came in b if inferred or ts > came or (clock and ts < clock - timedelta(hours=48)))
        clock = max([*([clock] if clock else []), *(ts for _, ts, inferred, came in b if not inferred and ts <= came)])
    assert late == behind > 60


def test_weights_go_on_from_the_store(spark, tmp_path):
    schema = "user_id long, key long, ts timestamp, seq long, signal double"
    rows = [(1, 1, START + timedelta(minutes=i), i, s) for i, s in enumerate([1.0, -1.0, 0.5, 0.8])] + [(2, 1, START, 9, 1.0)]
    stored = personal.ewma_weights(spark.createDataFrame(rows[:2], schema))
    out = []
    stream = files(spark, f"{tmp_path}/in", [rows[2:4], rows[4:]], schema)
    stateful.ewma(stream, stored=stored, idle_hours=24).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda d, n: out.extend(d.collect())).start().awaitTermination(200)
    want = {(r["user_id"], r["key"]): round(r["weight"], 4) for r in personal.ewma_weights(spark.createDataFrame(rows, schema)).collect()}
    assert {(r["user_id"], r["key"]): round(r["weight"], 4) for r in out} == want
