"""Top-k search by largest weights against summing all postings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import corpus as C
from tidewire.operators import index as X
from tidewire.operators import pipelines as P
from tidewire.sources.store import Scratch


@pytest.mark.parametrize(("head", "limit"), [(3, 5), (64, 10), (1, 3)])
def test_search_equals_summing_all_and_reads_less(spark, head, limit):
    rng = random.Random(head)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(3, 60))) for _ in range(160)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20] + ["", None])], "doc_id long, text string")
    queries = spark.createDataFrame([(k, " ".join(rng.sample(words, 4))) for k in range(12)] + [(50, "word0 word1 word2"), (51, "none of these"), (52, None)], "query_id long, text string")
    want = C.bm25(docs, queries, limit).collect()
    index = X.built(docs, Scratch(spark), head=head)
    got = X.search(index, queries, limit).collect()
    key = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 7)) for r in rows)
    assert key(got) == key(want) and len(got) > 30
    found = X.marked(index, C.query_terms(queries), limit)
    led, all_ = found.agg(F.sum(F.when(F.col("leads"), F.col("n"))), F.sum("n")).first()
    assert led <= all_ and (head != 64 or led < 0.8 * all_) and X.candidates(index, found).count() >= len({(r["query_id"], r["doc_id"]) for r in got})


def test_ties_go_by_date(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in range(6)] + [(9, "other words")], "doc_id long, text string")
    index = X.built(docs, Scratch(spark))
    dates = spark.createDataFrame([(0, "2024-01-01"), (1, "2024-01-03"), (2, None), (4, "2024-01-03"), (5, "2024-01-02")], "doc_id long, published_at string")
    got = X.search(index, spark.createDataFrame([(1, "same")], "query_id long, text string"), 5, dates).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [4, 1, 5, 0, 3]


def test_one_of_each_cluster(spark):
    rows = spark.createDataFrame([(1, i, 1.0 - i / 10, i) for i in range(6)], "query_id long, news_id long, score double, rank long")
    clusters = spark.createDataFrame([(0, 7), (2, 7), (1, 8), (4, 8)], "id long, cluster long")
    got = P.one_a_cluster(rows, clusters, 3).orderBy("rank").collect()
    assert [(r["news_id"], r["rank"]) for r in got] == [(0, 1), (1, 2), (3, 3)]


def test_search_with_candidates_explains_itself(spark):
    docs = spark.createDataFrame([(i, f"oil market {w} price. More text here.", "src") for i, w in enumerate(["rises", "falls", "holds", "exchange", "rises"])], "doc_id long, text string, source string")
    articles = docs.select("*", F.substring("text", 1, 20).alias("title"), F.col("text").alias("lead"), F.lit("title").alias("zone"), F.lit(0.5).alias("trust"), F.lit(2).alias("grade"), F.lit(0.5).alias("freshness"), F.lit(0.5).alias("value"))
    vocab = spark.createDataFrame([("exchange", 3), ("market", 5)], "term string, doc_frequency long")
    coll = spark.createDataFrame([("market", "price", 5.0, 9)], "term_a string, term_b string, pmi_score double, frequency long")
    queries = spark.createDataFrame([(1, "exchnge market"), (2, "zzz")], "query_id long, text string")
    found = P.candidates(docs, queries, vocab, coll)
    assert {(r["corrected"], r["was_corrected"], tuple(r["expansions"])) for r in found.collect()} == {("exchange market", True, ("market price",))}
    got = P.search(articles, queries.withColumnRenamed("text", "query"), found=found, clusters=spark.createDataFrame([(0, 1), (4, 1)], "id long, cluster long")).orderBy("rank").collect()
    assert got[0]["news_id"] == 3 and len(got) == 4 and got[0]["explanation"].startswith("retrieval=hybrid | expansion=market price")


def test_index_is_shuffled_as_lists_and_searched_where_documents_lie(spark, monkeypatch):
    """A row of postings is a term of a batch; blocks of a term go on; no pair of a query and a document is a row before it can be a result."""
    monkeypatch.setattr(X, "BLOCK", 5)
    rng = random.Random(9)
    words = [f"word{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(1, 20)))) for i in range(90)] + [(90, ""), (91, None), (92, "a b c")], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "word1 word2 word3"), (2, "word4"), (3, "nothing"), (4, "word5 word6 word7 word8")], "query_id long, text string")
    lists = C.term_postings(docs, 3)
    assert lists.count() < C.postings(docs, (3,)).count() / 2
    index = X.built(docs, Scratch(spark), head=4)
    stats = C.corpus_stats(docs)
    weights = C.bm25_weights(C.postings(docs, (3,)), stats)
    key = lambda df, c: sorted((r["term"], r["doc_id"], round(r[c], 9)) for r in df.collect())
    opened = X.opened(index.postings).join(index.tops, "term")
    assert key(opened.withColumn("w", F.col("idf") * F.col("share")), "w") == key(weights, "w")
    tops = {r["term"]: (r["n"], round(r["most"], 9)) for r in index.tops.collect()}
    assert tops == {r["term"]: (r["n"], round(r["most"], 9)) for r in weights.groupBy("term").agg(F.count("*").alias("n"), F.max("w").alias("most")).collect()}
    for r in index.postings.collect():
        assert len(r["docs"]) == min(5, r["n"] - 5 * r["block"]) and r["shares"] == sorted(r["shares"], reverse=True)
    found = X.search(index, queries, 6)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    best = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 7)) for r in df.collect())
    assert best(found) == best(C.bm25(docs, queries, 6))
    monkeypatch.setattr(C, "MATRIX", 1)
    assert best(X.search(index, queries, 6)) == best(found)


def test_index_of_nothing(spark):
    queries = spark.createDataFrame([(1, "word")], "query_id long, text string")
    for rows in ([], [(1, None)], [(1, ""), (2, "a b")]):
        index = X.built(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark))
        assert X.search(index, queries, 3).count() == 0 and index.tops.count() == 0
