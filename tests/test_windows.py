"""Whole time windows: no candidate is left out, however many there are."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.test_clustering import SCHEMA, items
from tidewire.operators import clustering
from tidewire.operators import events as E
from tidewire.plans import QUERIES, SQL
from tidewire.sources.store import Scratch


def pairs(rows, at_least):
    full = [r for r in rows if None not in (r[1], r[2], r[6])]
    near = {r[0]: [c for c in full if c is not r and c[1] == r[1] and abs(c[2] - r[2]) <= timedelta(hours=48)] for r in full}
    cos = lambda a, b: 0.0 if not (s := np.linalg.norm(a) * np.linalg.norm(b)) else float(np.dot(a, b) / s)
    assert max(map(len, near.values())) > 100
    return {(r[0], c[0]): round(s, 6) for r in full for c in near[r[0]] if (s := cos(r[6], c[6])) >= at_least}


@pytest.mark.parametrize("block", [8, 64, clustering.WIDE])
def test_every_candidate_of_a_window_is_compared(spark, block):
    rows = items(400, 7)
    got = clustering.window_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.7, Scratch(spark), block=block).collect()
    want = pairs(rows, 0.7)
    assert {(r["id"], r["other"]): round(r["score"], 6) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block", [16, clustering.WIDE])
def test_links_reach_what_pairs_reach(spark, block):
    rows = items(400, 8)
    for at_least in (0.7, 0.97):
        links = clustering.window_links(spark.createDataFrame(rows, SCHEMA).repartition(3), at_least, Scratch(spark), block=block)
        got = E.cluster_labels(links.selectExpr("id AS u", "other AS v"), spark.createDataFrame([(r[0],) for r in rows], "id long"), Scratch(spark))
        label = {r[0]: r[0] for r in rows}
        for u, v in pairs(rows, at_least):
            a, b = sorted((label[u], label[v]))
            label = {k: a if x == b else x for k, x in label.items()}
        assert {r["id"]: r["cluster"] for r in got.collect()} == label


def test_no_links(spark):
    assert clustering.window_links(spark.createDataFrame([], SCHEMA), 0.5, Scratch(spark)).count() == 0


def test_equal_vectors_are_few_rows_at_once(monkeypatch):
    """All pairs leave a task in small batches; links are one an item."""
    n = 600
    monkeypatch.setattr(clustering, "PAIRS", 1000)
    vector = pa.array([[1.0, 2.0]] * n, pa.list_(pa.float32()))
    place, none = pa.array(range(n), pa.int64()), pa.nulls(n, pa.int64())
    held = pa.record_batch({"id": place, "place": place, "vector": vector, "first": none, "last": none})
    asked = pa.record_batch({"id": place, "place": place, "vector": vector, "first": pa.array([0] * n, pa.int64()), "last": place})
    made = list(clustering._pairs(0.5, True)(iter([asked, held])))
    assert max(len(b) for b in made) <= 1000
    assert {(u, v) for b in made for u, v in zip(b["id"].to_pylist(), b["other"].to_pylist(), strict=True)} == {(u, v) for u in range(n) for v in range(n) if u != v} and sum(map(len, made)) == n * (n - 1)
    (links,) = clustering._reached(0.5)(iter([held, asked]))
    assert links.to_pydict() == {"id": list(range(1, n)), "other": [0] * (n - 1)}


def test_queries_compare_older_items_than_the_newest_hundred(spark, tmp_path):
    """Two like events, the oldest of 150 of a window."""
    duckdb = pytest.importorskip("duckdb")
    n = 150
    start = datetime(2024, 1, 1, tzinfo=timezone.utc).replace(tzinfo=None)
    eye = np.eye(n, dtype=np.float32)
    eye[1] = eye[0]
    pq.write_table(pa.table({"event_id": pa.array(range(n), pa.int64()), "ts": pa.array([start + timedelta(minutes=i) for i in range(n)], pa.timestamp("us")), "event_type": ["view"] * n}), tmp_path / "events.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(eye.tolist(), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert sorted(con.sql(SQL["event_cluster_pairs"]).fetchall()) == [(0, 1, 1.0), (1, 0, 1.0)]
    assert sorted(tuple(r) for r in QUERIES["event_cluster_pairs"](spark, str(tmp_path)).collect()) == [(0, 1, 1.0), (1, 0, 1.0)]
    assert {r["id"]: r["cluster"] for r in QUERIES["event_cluster_labels"](spark, str(tmp_path)).collect()} == {i: i if i != 1 else 0 for i in range(n)}
