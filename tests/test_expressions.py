"""Literal-value tests of expressions and operators, and of streaming twins against batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators import context, events, personal, relational, retrieval
from tidewire.sources import feeds, store
from tidewire.streaming import stateful


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "want"), [
    ("https://www.News-Site.org/a/b//?UTM_medium=mail&page=7&fbclid=1#c", "https://news-site.org/a/b?page=7"),
    ("http://example.com:80", "http://example.com/"), ("https://a.www.example.com:8443/x/", "https://a.www.example.com:8443/x"),
    ("https://example.com/?q=a%20b", "https://example.com/?q=a+b"), ("https://example.com/?q=a b", "https://example.com/?q=a+b"), ("https://example.com/?q=a+b&t=%7E*", "https://example.com/?q=a+b&t=~%2A"),
    ("https://user:pw@example.com/?from=x&b=", "https://example.com/?b="), ("", ""),
])
def test_canonical_url(spark, url, want):
    assert one(spark, T.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(("term", "want"), [("нефть", True), ("и", False), ("src", False), ("2024", False), ("рф", True), ("ab", False), ("a-b-c", False), ("x" * 65, False)])
def test_informative(spark, term, want):
    assert one(spark, T.is_informative(F.col("t")), t=term) is want


def test_text_expressions(spark):
    assert one(spark, T.unescape(F.lit("a &lt;b&gt; &amp;lt;"))) == "a <b> &lt;"
    assert one(spark, T.trigrams(F.lit("cat"))) == ["^ca", "cat", "at$"]
    assert one(spark, T.html_text(F.lit("<p>Hi&nbsp;<b>you</b></p><script>x()</script>"))) == "Hi you"
    assert one(spark, T.citations(F.lit("so [Doc 2], [Doc 1] and [Doc 2]"))) == [2, 1]
    assert one(spark, T.title_parts(F.lit("a // b"))[0]) == "a" and one(spark, T.title_parts(F.lit("a // b"))[1]) == "b"
    assert one(spark, T.author(F.lit("x@y.z (Jo Do)"))) == "Jo Do"
    assert one(spark, T.snippet(F.lit("No. The cat sat. End."), F.array(F.lit("cat")))) == "The cat sat."
    pair = F.array(F.lit("cat"), F.lit("dog"))
    assert one(spark, T.best_passage(F.lit("A cat. No. A dog. A cat and dog."), pair, 2)) == "A cat and dog. A cat."
    assert one(spark, T.best_passage(F.lit("Nothing here at all."), pair, 2, 7)) == "Nothing" and one(spark, T.best_passage(F.lit("A cat. A cat and dog."), pair, 3, 9)) == "A cat and"
    assert one(spark, T.unescape(F.lit("a&#1071;b&#x42F; &#0; &amp;#65; &#39"))) == "aЯbЯ &#0; &#65; '"
    assert one(spark, T.sentences(F.lit("  One.  0 two 0. 1 three 1."))) == ["One.", "0 two 0.", "1 three 1."]
    assert one(spark, T.rerank_document(F.lit(" T "), F.lit(None).cast("string"), F.lit("A cat. No."), pair)) == "T\nA cat."
    assert one(spark, T.digest_content(F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>"), F.lit("lead"), F.lit("lead"), F.lit(600))) == "topics: x, y\nlead"
    assert [one(spark, T.digest_budget(F.lit(n), 8000, 500)) for n in (0, 1, 10, 100)] == [1200, 1400, 1125, 600]
    assert one(spark, T.is_smalltalk(F.lit("  Как   дела "))) and not one(spark, T.is_smalltalk(F.lit("дела")))
    assert one(spark, T.is_refusal(F.lit("... не транслирует  мнение своих разработчиков"))) and one(spark, T.is_refusal(F.lit(None).cast("string"))) is False
    assert one(spark, T.explanation(F.lit("m"), F.array(F.lit("e")), F.lit("title"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.array(F.lit("k")), F.lit(True), F.lit("s"), F.lit(2))) == "retrieval=m | expansion=e | match in title | keywords=k | uncertain | source=s | grade=2"
    assert one(spark, T.is_breaking(F.lit("breaking: x"))) and one(spark, T.intent(F.lit("почему это важно"))[0]) == "CAPABILITY"
    when, inferred = T.rfc2822(F.lit("Sun, 03 Mar 2024 23:30:05 -0130"))
    assert str(one(spark, when.cast("string"))) == "2024-03-04 01:00:05" and one(spark, inferred) is False
    assert one(spark, T.rfc2822(F.lit("garbage"))[0]) is None


def test_scores(spark):
    L = F.lit
    assert [one(spark, S.grade(L(r), L(n), L(c))) for r, n, c in (("A", 2, False), ("C", 3, False), ("E", 1, False), ("B", 2, True), ("X", 1, False))] == [1, 3, 4, 5, 6]
    assert one(spark, S.decay(L(24.0), L("daily"))) == pytest.approx(0.5) and one(spark, S.decay(L(None).cast("double"), L("daily"))) == 0.5
    assert one(spark, S.cosine(F.array(L(1.0), L(0.0)), F.array(L(0.0), L(0.0)))) == 0
    assert one(spark, S.ewma_step(L(0.5), L(1.0))) == 0.625 and one(spark, S.ewma_step(L(0.5), L(-1.0))) == 0.375
    assert [one(spark, S.trend(L(c), L(b), L(s))) for c, b, s in ((3.0, 0.0, 2), (1.0, 0.0, 9), (5.0, 4.0, 2), (3.0, 4.0, 2))] == ["ascending", "stable", "ascending", "descending"]
    status, reasons = S.health(L(5), L(0.6), L(None).cast("double"), L(11.0), L(True), L(6), L(1), L(0.6), L(-0.4))
    assert one(spark, status) == "red" and len(one(spark, reasons)) == 8


def test_run_health(spark):
    rows = [("s", i, i, st, 0) for i, st in enumerate(["success", "failed", "skipped", "failed"])] + [("t", 1, 1, "success", 0)]
    got = {r["source"]: r for r in events.run_health(spark.createDataFrame(rows, "source string, run long, ts long, status string, errors int")).collect()}
    assert (got["s"]["failures"], got["s"]["streak"], got["s"]["skips"]) == (2, 0, 1) and got["t"]["streak"] == 1


def test_chunk_windows():
    got = context.chunk_windows([10] * 90, 420, 70)
    assert got[0] == (0, 42) and got[1][0] == 35 and got[-1][1] == 90
    assert context.chunk_windows([500, 5], 420, 70) == [(0, 1), (1, 2)] or context.chunk_windows([500, 5], 420, 70)[0] == (0, 1)
    assert context.chunk_windows([]) == []


def test_caps_and_digest(spark):
    rows = [("q", i, i, 1 if i < 5 else 2, ["a"] if i % 2 else [], 1.0 - i / 100) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "key string, rank long, news_id long, source_id long, topics array<string>, score double")
    order = [r["news_id"] for r in personal.capped(df, 9, 3).orderBy("position").collect()]
    assert order == [1, 2, 3, 5, 6, 7, 4, 8]
    sent = spark.createDataFrame([("q", 1)], "key string, news_id long")
    got = [(r["news_id"], r["fallback"]) for r in personal.digest(df, 4, sent).orderBy("position").collect()]
    assert got == [(2, False), (3, False), (4, False), (5, False)]
    assert [r["news_id"] for r in personal.diversified(df, 0.5).orderBy("position").collect()][0] == 1


def test_fusion_and_orphans(spark):
    lists = spark.createDataFrame([(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", 11, 1)], "query_id long, list string, id long, rank long")
    assert [r["id"] for r in retrieval.fused(lists).orderBy("rank").collect()] == [11, 10]
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    assert {(r["id"], r["status"]) for r in relational.reconciled(a, b, "id").collect()} == {(1, "missing"), (2, "ok"), (3, "orphan")}
    old = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k long, v long, s string")
    new = spark.createDataFrame([(2, 2, "z"), (3, 1, "w")], "k long, v long, s string")
    assert {(r["k"], r["s"]) for r in store.upsert(old, new, "k", "v").collect()} == {(1, "x"), (2, "z"), (3, "w")}


def test_feed_items(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>Big // News</title><link>https://www.a.com/x/?utm_a=1</link><guid>1</guid><category>c1</category><category>c2</category><pubDate>Tue, 14 Apr 2026 10:00:00 +0300</pubDate><description>&lt;p&gt;Hello&lt;/p&gt;</description></item><item><title>No link</title></item></channel></rss>")
    good, bad = feeds.items(feeds.read_rss(spark, str(tmp_path / "feed.xml")))
    row = good.first()
    assert (row["title"], row["subtitle"], row["canonical_url"], row["text"], row["categories"]) == ("Big", "News", "https://a.com/x", "Hello", ["c1", "c2"])
    assert bad.first()["error"] == "data_missing" and good.count() == bad.count() == 1


def test_streams_equal_batches(spark, tmp_path):
    rows = [(1, k, f"2026-01-01 00:00:{10 + i:02d}", i, s) for k in (1, 2) for i, s in enumerate((1.0, -1.0, 0.5, 0.3))]
    df = spark.createDataFrame(rows, "user_id long, key long, ts string, seq long, signal double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    stateful.ewma(stream).writeStream.format("memory").queryName("weights").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(90)
    want = {(r["key"], r["weight"]) for r in personal.ewma_weights(df).collect()}
    assert {(r["key"], r["weight"]) for r in spark.table("weights").collect()} == want
    twice = stream.union(stream)
    stateful.deduplicated(twice.withColumn("id", F.concat_ws("-", "key", "seq")), "id", "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination(90)
    assert spark.table("once").count() == len(rows)


def test_plugins_and_chunks(spark):
    import pyarrow as pa

    from tidewire import plugins
    from tidewire.operators import articles

    docs = spark.createDataFrame([(1, "Paris and Lyon. Paris!"), (2, None), (3, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["entity"]): (r["mentions"], r["name"]) for r in articles.entity_mentions(plugins.entities(docs), spark.createDataFrame([("lyon", "lugdunum")], "alias string, entity string")).collect()}
    assert got == {(1, "paris"): (2, "Paris"), (1, "lugdunum"): (1, "Lyon")}

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([["x"]] * batch.num_rows)], ["doc_id", "lemmas"])

    assert {tuple(r["lemmas"]) for r in plugins.lemmas(docs, make).collect()} == {("x",)}
    assert len(plugins.embeddings(docs).first()["vector"]) == 64
    at, weight = plugins.lexical_weights(F.expr("map(7, 0.5, 3, 0.0, 2, 1.0)"))
    assert one(spark, at) == [2, 7] and [float(x) for x in one(spark, weight)] == [1.0, 0.5]
    body = " ".join(f"Sentence number {i} has six words." for i in range(40))
    rows = spark.createDataFrame([(1, " Title ", body, None), (2, "", "  ", "Lead only."), (3, None, None, None)], "doc_id long, title string, body string, fallback string")
    made = sorted(articles.chunks(rows, 60, 12).collect(), key=lambda r: (r["doc_id"], r["chunk_index"]))
    first = [r for r in made if r["doc_id"] == 1]
    assert (first[0]["zone"], first[0]["text"]) == ("title", "Title") and {r["total_chunks"] for r in first} == {len(first)}
    assert [(r["start"], r["end"]) for r in first[1:]] == [(r["start"], r["start"] + len(r["text"])) for r in first[1:]] and all(body[r["start"] : r["end"]] == r["text"] for r in first[1:])
    assert all(r["tokens"] <= 60 for r in first) and all(b["start"] < a["end"] for a, b in zip(first[1:], first[2:], strict=False))
    assert [(r["doc_id"], r["text"]) for r in made if r["doc_id"] > 1] == [(2, "Lead only.")]


def test_cooldown_stream(spark, tmp_path):
    rows = [(k, f"2026-01-01 0{h}:{m:02d}:00") for k in ("a", "b") for h, m in ((0, 0), (0, 20), (0, 31), (0, 50), (1, 1), (2, 0))]
    df = spark.createDataFrame(rows, "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    stateful.cooled_down(stream).writeStream.format("memory").queryName("cooled").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(90)
    got = sorted((r["key"], r["ts"].strftime("%H:%M")) for r in spark.table("cooled").collect())
    assert got == [(k, t) for k in ("a", "b") for t in ("00:00", "00:31", "01:01", "02:00")]
