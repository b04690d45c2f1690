"""Terms of documents are counted by arrays, as the expressions on words count them."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import corpus as C
from tidewire.sources.store import Scratch

TEXTS = ["Oil oil, ÖL-öl!  x1 a bb ccc", "", None, "... !!", "ΣΑΣ İstanbul ǅ ﬁ ß ё Ё е\u0301 ४२ Ⅷ ½ 日本語 \U0001d400\U0001f600 a_b", "one two three four five six seven", "рынок Рынок нефти и нефть"]


def _docs(spark, n=40):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(80)] + ["ab", "a", "Нефть"]
    made = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(1, 50))) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(TEXTS + made)), "doc_id long, text string").repartition(3)


def _expected(docs, least):
    """(doc_id, words of ``least`` letters) by the expressions."""
    return {r["doc_id"]: [w for w in r["w"] if len(w) >= least] for r in docs.select("doc_id", T.words(F.col("text")).alias("w")).collect() if r["w"]}


def test_postings_equal_the_expressions_and_make_no_row_an_occurrence(spark):
    docs = _docs(spark)
    for size in ("1", "10000"):  # rows of a batch
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted(tuple(r) for r in C.postings(docs, (2, 3)).select("doc_id", "term", "size_2", "size_3", "tf").collect())
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        want = []
        for i, words in _expected(docs, 2).items():
            want += [(i, w, len(words), sum(len(x) >= 3 for x in words), n) for w, n in Counter(words).items()]
        assert got == sorted(want)
    plan = C.postings(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_sparse_vectors_hash_a_term_once_a_batch(spark):
    docs = _docs(spark)
    rows = docs.select("doc_id", F.explode(T.words(F.col("text"), 2)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    rows = rows.join(rows.groupBy("doc_id").agg(F.sum("tf").alias("size")), "doc_id").groupBy("doc_id", T.hash_number(F.col("term"), 2).alias("idx")).agg(F.round(F.sum(F.col("tf") / F.col("size")), 6).alias("val"))
    made = C.sparse_vectors(docs, digits=2)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.collect()))
    assert "sha2" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_rounded_is_round(spark):
    values = [1 / 128, 1 / 64, 3 / 128, 0.0000005, 0.0000015, 1 / 3, 2 / 3, 1.0, 5 / 8192, 0.1234565, 1e-9] + [i / (2 * 10**6) for i in range(1, 4000, 7)]
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    assert C.rounded(np.array(values), 6).tolist() == want


def test_keywords_look_up_only_what_can_be_best(spark, monkeypatch):
    """Whatever number of terms is known to all tasks, the result is that of weighing all postings; ties and documents of few terms too."""
    docs = _docs(spark, 60).union(spark.createDataFrame([(900 + i, "same words in copies of texts, word1 word2") for i in range(5)], "doc_id long, text string"))
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "term")
    want = C.tfidf(docs, 4).withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    key = lambda df: sorted((r["doc_id"], r["rank"], r["term"], round(r["weight"], 9)) for r in df.collect())
    want = key(want)
    for known in (0, 5, 10**6):
        monkeypatch.setattr(C, "KNOWN", known)
        assert key(C.keywords(docs, 3)) == want
    lists = Scratch(spark).put(C.term_lists(docs, 4))
    all_ = lists.select(F.explode("terms").alias("term"))
    df = all_.groupBy("term").agg(F.count("*").alias("df")).toArrow().combine_chunks()
    some = lists.mapInArrow(C._promising(df["term"].combine_chunks(), df["df"].to_numpy(), 1, docs.count(), 3), "doc_id long, size int, term string, tf long")
    assert some.count() < all_.count() / 2


def test_process_articles_shuffles_no_postings(spark):
    """What its keywords shuffle is what can be best, not every term of every document."""
    from tidewire.plans import QUERIES

    plan = QUERIES["process_articles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "found(doc_id" in plan and "tf#" in plan and "size_4" not in plan
