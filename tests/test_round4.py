"""Steps of the last round against the plain ways."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import corpus as C
from tidewire.operators import maintenance as N


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def texts(spark, n=40):
    rng = random.Random(8)
    words = "ещё еще это всё aa market 12 1a ½ ª price the list и дом x İstanbul http".split()
    made = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randrange(0, 30))) if i % 9 else None) for i in range(n)]
    return spark.createDataFrame(made, "doc_id long, text string")


def test_cheap_rule_looks_up_no_letters_one_by_one(spark):
    tokens = C.terms(texts(spark)).distinct()
    made = tokens.select("term", T.is_informative_token(F.col("term")).alias("x"))
    assert rows(made) == rows(tokens.select("term", T.is_informative(F.col("term")).alias("x")))
    assert "translate(" not in made._jdf.queryExecution().optimizedPlan().toString()
    # the pair rule as well
    pair = C.pairs(texts(spark)).select("a", "b", C.useful_pair(F.col("a"), F.col("b")).alias("x"))
    assert "translate(" not in pair._jdf.queryExecution().optimizedPlan().toString()
    assert rows(pair) == rows(C.pairs(texts(spark)).select("a", "b", T.is_informative_pair(F.col("a"), F.col("b")).alias("x")))


def test_changes_are_summed_with_what_was_before_in_one_shuffle(spark):
    before = texts(spark)
    batch = texts(spark, 25).where("doc_id % 2 = 0").withColumn("text", F.reverse("text")).withColumn("deleted", F.col("doc_id") % 4 == 0)
    signed, after = N.changes(before, batch, "doc_id"), N.applied(before, batch, "doc_id")
    terms, pairs = N.merged(N.term_rows(before), N.term_rows(signed), ["term"]), N.merged(N.pair_rows(before), N.pair_rows(signed), ["a", "b"])
    assert rows(terms) == rows(C.terms(after, 2).groupBy("term").agg(F.count("*").alias("n")))
    assert rows(pairs) == rows(C.pairs(after).where(C.useful_pair(F.col("a"), F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n")))
    plain = N.merged(N.term_rows(before), N.term_rows(before.withColumn("sign", F.lit(-1))), ["term"])
    assert exchanges(plain) == 1 and not plain.count()


@pytest.mark.parametrize("numbers", [4_000_000, 0])
def test_best_products_equal_sums_of_joined_rows(spark, monkeypatch, numbers):
    """Documents that go on in the next batch, copies, weights of nothing, documents without an id or a shared key; as a matrix and joined."""
    monkeypatch.setattr(C, "MATRIX", numbers)
    monkeypatch.setattr(C, "ROWS", 3)
    rng = random.Random(3)
    posts = [(d if d else None, k, rng.choice([0.0, 0.5, 1.25])) for d in range(40) for k in rng.sample("abcdefgh", rng.randrange(1, 7))] + [(d, "c", 0.5) for d in range(50, 70)] + [(90, "z", 1.0)]
    posts = spark.createDataFrame(posts, "doc_id long, term string, x double").repartition(3)
    asked = spark.createDataFrame([(q, k, w) for q in range(6) for k, w in (("abcdefgh"[q], 1.5), ("abcdefgh"[q + 1], 0.25))] + [(9, "none", 1.0)], "query_id long, term string, weight double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = rows(C.best_products(posts, asked, "term", 5).where("doc_id IS NOT NULL"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = posts.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("x") * F.col("weight")).alias("score"))
    assert got == rows(C.best_documents(want, 5).where("doc_id IS NOT NULL"))


def test_judged_rows_are_made_once(spark):
    from tidewire.operators import retrieval as R

    judged = spark.range(30).selectExpr("id % 3 AS query_id", "1 + id div 3 AS rank", "int(id % 2) AS relevance", "id % 4 AS source")
    assert "Range" not in R.ir_metrics(judged)._jdf.queryExecution().optimizedPlan().toString()


def test_spoilt_words_are_counted_as_in_sql(spark):
    """A text that begins with a line break has an empty word there, which counts as a place."""
    from types import SimpleNamespace

    from tidewire.plans.corpus import spoilt_queries

    benchmark = spark.createDataFrame([(1, "\nmarketing statement"), (2, "marketing statement")], "item_id long, text string")
    assert rows(spoilt_queries(SimpleNamespace(benchmark=benchmark))) == [(1, "marketing statement"), (2, "maketing statement")]
