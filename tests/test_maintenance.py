"""Counts after random batches against counts made anew, and tables of files by key."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewire.operators import corpus as C
from tidewire.operators import maintenance as N


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_after_batches_equal_those_made_anew(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(rng.randrange(0, 8))) if rng.random() > 0.1 else None
    current = spark.createDataFrame([(i, text()) for i in range(30)], "doc_id long, text string")
    terms, pairs = C.term_counts(current), C.pairs(current).groupBy("a", "b").agg(F.count("*").alias("n"))
    for turn in range(3):
        batch = spark.createDataFrame([(i, text(), rng.choice([True, False, None])) for i in rng.sample(range(40), 15)], "doc_id long, text string, deleted boolean")
        signed = N.changes(current, batch, "doc_id")
        terms, pairs = (spark.createDataFrame(x.collect(), x.schema) for x in (N.merged(terms, N.term_delta(signed), ["term"]), N.merged(pairs, N.pair_delta(signed), ["a", "b"])))
        current = N.applied(current, batch, "doc_id")
        current = spark.createDataFrame(current.collect(), current.schema)
        assert rows(terms) == rows(C.term_counts(current)) and rows(pairs) == rows(C.pairs(current).groupBy("a", "b").agg(F.count("*").alias("n")))


def test_edges_follow_the_cap(spark):
    former = spark.createDataFrame([(1, e) for e in range(2, 8)] + [(2, 3), (2, 4)], "item long, entity long")
    new = spark.createDataFrame([(1, e) for e in range(1, 6)], "item long, entity long")  # the least entity pushes others out of a cap of three; item 2 goes
    for most in (3, 10):
        got = N.merged(C.cooccurrence(former, most), N.edge_delta(former, new, most), ["a", "b"])
        assert rows(got) == rows(C.cooccurrence(new, most))


def test_files_by_key(spark, tmp_path):
    path = (tmp_path / "vectors").as_uri()
    make = lambda *r: spark.createDataFrame(list(r), "id long, v array<float>, at long")
    N.upsert_files(spark, path, make((1, [1.0], 1), (2, [2.0], 1), (2, [2.5], 2), (None, [9.0], 1)), "id", "at", 8)
    N.upsert_files(spark, path, make((2, [0.0], 1), (3, [3.0], 1), (1, [1.5], 1)), "id", "at", 8)
    want = [(1, [1.5], 1), (2, [2.5], 2), (3, [3.0], 1), (None, [9.0], 1)]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in N.files(spark, path).collect()), key=key) == want
    N.upsert_files(spark, path, make(), "id", "at", 8)
    N.upsert_files(spark, path, make((3, [3.0], 1)), "id", "at", 8)
    assert sorted((tuple(r) for r in N.files(spark, path).collect()), key=key) == want
