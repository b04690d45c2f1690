"""Event clusters against the sequence of decisions that they stand for, and window pairs against all pairs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from tidewire.operators import clustering
from tidewire.sources.store import Scratch

SCHEMA = "id long, lang string, ts timestamp, story string, related array<string>, url string, vector array<float>, block string"


def items(n, seed):
    rng = random.Random(seed)
    start, base = datetime(2024, 1, 1, tzinfo=timezone.utc), [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in rng.sample(range(10 * n), n):
        hour = rng.choice([0, 0, 0, rng.randrange(200)])  # a third and more of all rows at one time
        vector = None if rng.random() < 0.1 else [0.0] * 6 if rng.random() < 0.05 else np.float32([x + rng.gauss(0, 0.5) for x in rng.choice(base)]).tolist()
        story = rng.choice(["", "", "", None, " s1", "s1 ", "s2"])
        related = rng.choice([None, [], ["u1"], ["u2 ", ""], [f"u{i % 9}"]])
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.05 else start + timedelta(hours=hour), story, related, rng.choice([None, "", f"u{i % 7}"]), vector, "clash"))
    return rows


def fold(rows, newest, hours, threshold):
    """Labels one after another."""
    label = {}
    clean = lambda x: (x or "").strip()
    cos = lambda a, b: 0.0 if not (s := np.linalg.norm(a) * np.linalg.norm(b)) else float(np.dot(a, b) / s)
    order = sorted((r for r in rows if r[2] is not None and r[1] is not None), key=lambda r: (r[2], r[0]))
    for r in rows:
        label[r[0]] = r[0]
    for k, r in enumerate(order):
        near = [c for c in order[:k] if c[1] == r[1] and c[2] >= r[2] - timedelta(hours=hours)][::-1][:newest]
        hard = [c for c in near if clean(r[3]) and clean(c[3]) == clean(r[3])]
        if hard:
            label[r[0]] = min([r[0], *(label[c[0]] for c in hard)])
            continue
        best, at = None, threshold - 1e-12
        for c in near:
            if r[6] is None or c[6] is None:
                continue
            mine, other = ({clean(x) for x in x or ()} - {""} for x in (r[4], c[4]))
            urls = {clean(r[5]), clean(c[5])}
            score = round(cos(r[6], c[6]) + (0.2 if mine & other or mine & urls or other & urls else 0), 9)
            if score > at:
                best, at = c, score
        if best:
            label[r[0]] = min(r[0], label[best[0]])
    return label


@pytest.mark.parametrize(("block", "newest", "n"), [(16, 5, 250), (2048, 100, 250), (7, 30, 120)])
def test_arrival_clusters_equal_the_fold(spark, block, newest, n):
    rows = items(n, block)
    got = clustering.arrival_clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold=0.75, newest=newest, block=block).collect()
    assert {r["id"]: r["cluster"] for r in got} == fold(rows, newest, 48, 0.75) and len(got) == n
    assert any(r["id"] != r["cluster"] for r in got)


def test_no_items(spark):
    assert clustering.arrival_clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    assert clustering.window_pairs(spark.createDataFrame([], SCHEMA), 0.5, Scratch(spark)).count() == 0


def test_least_above_walks_long_paths(spark):
    ids = list(range(1, 400))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids[1:], ids[:-1], strict=True)), "id long, up long")
    got = {r["id"]: r["least"] for r in clustering.least_above(links, Scratch(spark)).collect()}
    assert got == {x: min(ids[: k + 1]) for k, x in enumerate(ids) if k}


@pytest.mark.parametrize(("block", "newest"), [(8, 5), (2048, 100)])
def test_window_pairs_equal_all_pairs(spark, block, newest):
    rows = items(150, 3)
    got = clustering.window_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.5, Scratch(spark), newest=newest, block=block).collect()
    full = [r for r in rows if None not in (r[1], r[2], r[6])]
    want = {}
    for r in full:
        near = sorted((c for c in full if c is not r and c[1] == r[1] and abs(c[2] - r[2]) <= timedelta(hours=48)), key=lambda c: (c[2], c[0]), reverse=True)[:newest]
        for c in near:
            s = np.linalg.norm(r[6]) * np.linalg.norm(c[6])
            if s and np.dot(r[6], c[6]) / s >= 0.5:
                want[r[0], c[0]] = round(np.dot(r[6], c[6]) / s, 6)
    assert {(r["id"], r["other"]): round(r["score"], 6) for r in got} == want and len(got) == len(want)
