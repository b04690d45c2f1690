"""Nearest vectors by tiles against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.operators import retrieval as R


@pytest.mark.parametrize("numbers", [4_000_000, 40])
def test_knn_equals_all_pairs(spark, monkeypatch, numbers):
    """With copies, equal and odd vectors, in one block of queries and in many; pairs of usual vectors are made by no join."""
    monkeypatch.setattr(R, "BROADCAST_NUMBERS", numbers)
    monkeypatch.setattr(R, "TILE", 7)
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(60)] + [(100 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(20)]
    rows += [(200, [0.0] * 4), (201, None), (202, [1.0, None, 2.0, 0.0]), (203, [1.0, 2.0]), (204, [float("nan"), 1.0, 1.0, 1.0]), (100, [1.0, 2.0, 0.0, 1.0]), (None, [1.0, 2.0, 0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    queries = vectors.where("id % 5 = 0 OR id > 199").withColumnRenamed("id", "query_id")
    pairs = vectors.crossJoin(queries.withColumnRenamed("vector", "q")).select("query_id", "id", S.cosine(F.col("vector"), F.col("q")).alias("score"))
    want = R.ranked(pairs, ["query_id"], [F.desc(F.round("score", 9)), F.col("id")], 6)
    same = lambda df: sorted(map(str, df.select("query_id", "id", "rank", "score").collect()))
    assert same(R.knn(vectors, queries, 6)) == same(want)


def test_knn_multiplies_matrices(spark):
    plan = R.knn(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"), spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 1)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan


def test_ranking_metrics_share_the_step(spark):
    from tidewire.plans import QUERIES

    plan = QUERIES["ranking_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_expansions_make_collocations_once_and_judge_those_that_a_query_meets(spark):
    from tidewire.operators import corpus as C

    coll = spark.createDataFrame([("market", "price", 4.0, 9), ("price", "list", 3.5, 8), ("abcd", "efgh", 5.0, 7), ("market", "и", 9.0, 9), ("market", "rare", 9.0, 4)], "term_a string, term_b string, pmi_score double, frequency long")
    queries = spark.createDataFrame([(1, "Market news"), (2, "price list of today"), (3, None), (4, "list")], "query_id long, text string")
    made = C.expansions(queries, coll)
    assert sorted((r["query_id"], r["phrase"], r["rank"]) for r in made.collect()) == [(1, "market price", 1), (4, "price list", 1)]
    # neither the collocations nor the queries are in the plan any more, however often it reads them
    assert "LogicalRDD" not in _plan(made) and "LocalRelation" not in _plan(made)


def test_rule_on_tokens_is_the_rule_on_terms(spark):
    """Tokens hold letters and digits in lower case."""
    from tidewire.functions import text as T

    tokens = ["и", "что", "её", "ее", "ещё", "http", "usr", "123", "١٢", "a1", "ab", "abc", "ai", "ии", "x" * 64, "x" * 65, "1ab", "данные", "über", "日本", "日本語", "ёлка", "апрель", "", None]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", T.is_informative_token(F.col("t")).alias("a"), T.is_informative(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows), rows


def test_pairs_are_judged_by_a_cheap_rule(spark):
    from tidewire.operators import corpus as C

    docs = spark.createDataFrame([(1, "Oil price. oil  price!\n\nPrice a.b oil? x 5 price... Gas\tprice"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in C.pairs(docs).collect()) == [("gas", "price"), ("oil", "price"), ("oil", "price"), ("price", "oil")]
    assert "regexp_replace" not in _plan(C.pairs(docs).where(C.useful_pair(F.col("a"), F.col("b"))))


def test_places_are_found_without_vectors(spark):
    """What is written between has no vectors, which weigh most."""
    from tidewire.operators import clustering as K
    from tidewire.sources.store import Scratch

    scratch = Scratch(spark)
    items = spark.createDataFrame([(i, "en", 1700000000 + i, [1.0, float(i % 3)]) for i in range(12)], "id long, lang string, t long, vector array<float>").withColumn("ts", F.timestamp_seconds("t"))
    pairs = K.window_pairs(items, 0.99, scratch, newest=5, block=4)
    assert {(r["id"], r["other"]) for r in pairs.collect()} == {(i, j) for i in range(12) for j in [x for x in range(11, -1, -1) if x != i][:5] if i % 3 == j % 3}
    assert scratch.made and all("vector" not in t.columns for _, t in scratch.made)


def test_labels_shrink_edges(spark):
    """Long paths, stars and single nodes; after a round, edges within a cluster are gone."""
    from tidewire.operators import events as E
    from tidewire.sources.store import Scratch

    rng = random.Random(3)
    path = rng.sample(range(40), 40)
    edges = [*zip(path, path[1:], strict=False), *((100, i) for i in range(101, 120)), (200, 199), (200, 201), (200, 200), (201, 200)]
    scratch = Scratch(spark)
    nodes = [*range(40), *range(100, 120), 199, 200, 201, 300]
    made = E.cluster_labels(spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(n,) for n in nodes], "id long"), scratch)
    assert {r["id"]: r["cluster"] for r in made.collect()} == {n: 0 if n < 40 else 100 if n < 120 else 199 if n < 300 else 300 for n in nodes}
    assert len([t for _, t in scratch.made if t.columns == ["u", "v"]]) > 1


def test_page_functions_bound_batches(spark):
    """Python gets pages and texts in batches of few bytes, however many rows there are."""
    from tidewire.plans import QUERIES
    from tidewire.sources.store import BATCH

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for query in ("short_safe_articles", "turbo_articles", "keyphrases"):
        spark.conf.unset(name)
        try:
            QUERIES[query](spark, "/root/testdata/sf0.001")
            assert int(spark.conf.get(name).rstrip("b")) == BATCH
        finally:
            spark.conf.unset(name)
    spark.conf.set(name, "1000")  # a caller's own bound stays
    try:
        QUERIES["turbo_articles"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(name).rstrip("b") == "1000"
    finally:
        spark.conf.unset(name)


def test_keyphrases_judge_the_best_alone(monkeypatch):
    """Phrases are rounded, joined and compared only as far as the best need it, with the result of judging all."""
    from tidewire.operators import keyphrases as K

    rng = random.Random(2)
    text = ". ".join(" ".join(rng.choice(["oil", "oils", "Market", "market", "price", "prices", "RATE", "12"]) + "x" * rng.randrange(3) for _ in range(9)) for _ in range(60))
    every = K.keyphrases(text, 10**6, alike=1.0)
    kept = []
    for p, s in every:
        if not any(K.too_alike(p, q, 0.8) for q, _ in kept):
            kept.append((p, s))
    joined = []
    monkeypatch.setattr(K, "round", lambda s, n: joined.append(s) or round(s, n), raising=False)
    assert K.keyphrases(text, 5, alike=1.0) == every[:5] and len(joined) < len(every) / 4
    assert K.keyphrases(text, 5, alike=0.8) == kept[:5] and K.keyphrases(text, 200, alike=0.8) == kept[:200]


def test_rerank_split_sorts_twice(spark):
    """One shuffle by query, and no sort for the count of its hits."""
    from tidewire.operators import retrieval as R

    rows = [(1, n, s, float((n * 7 + s) % 5)) for n in range(4) for s in range(3)] + [(2, 1, 0, 1.0), (2, 1, 1, 2.0), (2, 2, 0, None)]
    made = R.rerank_split(spark.createDataFrame(rows, "query_id long, news_id long, seq int, score double"), 3)
    got = {(r["query_id"], r["news_id"], r["seq"]) for r in made.where("to_rerank").collect()}
    best = sorted((min((-x[3], x[2], n) for x in rows if x[0] == 1 and x[1] == n) for n in range(4)))[:3]
    assert got == {(1, n, s) for _, s, n in best} | {(2, 1, 0), (2, 1, 1), (2, 2, 0)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_sparse_vectors_shuffle_texts_alone(spark):
    from tidewire.operators import corpus as C

    made = C.sparse_vectors(spark.createDataFrame([(1, "oil oil gas"), (2, None)], "doc_id long, text string"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(r["val"] for r in made.collect()) == [0.333333, 0.666667]
