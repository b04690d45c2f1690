"""Poisoned rows, whole batches, and what pages' answers make of waiting articles."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.functions import dom
from tidewire.operators import batches as B
from tidewire.sources.store import Scratch


def work(batch):
    values = batch["v"].to_pylist()
    if any(v is not None and v < 0 for v in values):
        raise ZeroDivisionError("negative")
    at = [i for i, v in enumerate(values) for _ in range(v or 0)]
    return pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), pa.array([str(i) for i in at])], ["id", "note"])


@pytest.mark.parametrize("poisoned", [(), (3,), (0, 1, 2, 3, 4), range(40), (7, 39)])
def test_failing_rows_stand_alone(spark, poisoned):
    rows = [(i, -1 if i in poisoned else i % 3) for i in range(40)] + [(None, -1)]
    published = []
    good, dead, counts = B.run_batch(spark.createDataFrame(rows, "id long, v long").coalesce(1), work, "id long, note string", "id", Scratch(spark), publish=lambda d: published.append(sorted(r[0] for r in d.collect())))
    want = [i for i in range(40) if i not in poisoned for _ in range(i % 3)]
    assert sorted(r["id"] for r in good.collect()) == want and published == [sorted(set(want))]
    assert sorted((r["id"] or "", r["error"]) for r in dead.collect()) == sorted([(str(i), "ZeroDivisionError: negative") for i in poisoned] + [("", "ZeroDivisionError: negative")])
    assert tuple(counts.first()) == (41, len(set(want)), 41 - len(set(want)) - len(poisoned) - 1, len(poisoned) + 1)


def test_a_batch_takes_the_first(spark):
    good, dead, counts = B.run_batch(spark.createDataFrame([(i, 1) for i in range(9)], "id long, v long"), work, "id long, note string", "id", Scratch(spark), 3, [F.desc("id")])
    assert sorted(r["id"] for r in good.collect()) == [6, 7, 8] and dead.count() == 0 and counts.first()["selected"] == 3
    none = B.run_batch(spark.createDataFrame([], "id long, v long"), work, "id long, note string", "id", Scratch(spark))
    assert none[0].count() == 0 and tuple(none[2].first()) == (0, 0, 0, 0)


def test_answers(spark):
    body = "<article><p>Title</p><p>lead</p><p>" + "b" * 220 + "</p></article>"
    waiting = spark.createDataFrame([(1, "x", "s", "u1", "Title"), (2, "y", "s", "u2", None), (3, "x", "s", "u3", None), (4, "x", "s", "u4", None), (5, "x", "s", "none", None)], "id long, source string, site string, url string, title string")
    pages = spark.createDataFrame([("u1", 200, body), ("u2", 451, body), ("u3", 404, body), ("u4", 200, "<p>short</p>"), ("u1", 200, body)], "url string, code int, html string")
    site = dom.Extractor({"s": dom.Site(("p",), roots=("article",), must=True)})
    done = B.enriched(waiting, pages, site, lead_after_title=("x",))
    got = {r["id"]: (r["content"], r["status"], r["method"], r["http_status"]) for r in done.collect()}
    assert got == {1: ("b" * 220, "ok", "site", 200), 2: (None, "paywall", "http_error", 451), 3: (None, "extraction_failed", "http_error", 404), 4: (None, "extraction_failed", "failed_all_levels", 200), 5: (None, "extraction_failed", "http_error", None)}
    articles = waiting.select("id", "source", F.lit(None).cast("string").alias("content"), F.lit("partial").alias("status"))
    asked = spark.createDataFrame([("x", False), ("y", True), ("z", True)], "source string, rerun_requested boolean")
    runs = {r["source"]: tuple(r)[1:] for r in B.enrichment_runs(articles, done, asked).collect()}
    assert runs == {"x": (4, 1, 3, "partial", True), "y": (1, 0, 1, "partial", False), "z": (0, 0, 0, "success", False)}
