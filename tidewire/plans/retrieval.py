"""Retrieval queries: embeddings as chunk vectors (label as relevance), documents and benchmark for text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators import retrieval as R
from tidewire.plans.corpus import BM25
from tidewire.plans.registry import query

KNN = """s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s), k AS (SELECT * FROM r WHERE rank <= 10)"""


def nearest(t, limit=10):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    # one more than asked: the query finds itself
    near = R.knn(vectors, queries, limit + 1).where("id <> query_id")
    return R.ranked(near.drop("rank"), ["query_id"], [F.desc(F.round("score", 9)), F.col("id")], limit)


@query(f"WITH {KNN} SELECT query_id, id, round(score, 5) AS score, rank FROM k")
def knn_cosine_topk(t):
    return nearest(t).withColumn("score", F.round("score", 5))


@query(f"""WITH {KNN}, n AS (SELECT l.label AS want, k.*, e.label AS got FROM k JOIN embeddings l ON l.vec_id = k.query_id JOIN embeddings e ON e.vec_id = k.id),
j AS (SELECT query_id, rank, CASE WHEN want = got THEN 2 WHEN abs(want - got) = 1 THEN 1 ELSE 0 END AS relevance, got AS source FROM n), i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS ir FROM j),
x AS (SELECT query_id, sum((2.0::DOUBLE ** relevance - 1) / log2(ir + 1)) AS ideal FROM i GROUP BY query_id)
SELECT j.query_id, round((count(*) FILTER (relevance > 0)) / 10.0::DOUBLE, 6) AS precision_at_k, round(coalesce(1.0::DOUBLE / min(CASE WHEN relevance > 0 THEN rank END), 0), 6) AS reciprocal_rank,
round(coalesce(sum((2.0::DOUBLE ** relevance - 1) / log2(rank + 1)) / nullif(max(ideal), 0), 0), 6) AS ndcg, round(count(DISTINCT source)::DOUBLE / count(*), 6) AS diversity FROM j JOIN x ON j.query_id = x.query_id GROUP BY j.query_id""")
def ranking_metrics(t):
    label = lambda k, n: t.embeddings.select(F.col("vec_id").alias(k), F.col("label").alias(n))
    rows = nearest(t).join(label("query_id", "want"), "query_id").join(label("id", "got"), "id")
    judged = rows.select("query_id", "rank", F.when(F.col("want") == F.col("got"), 2).when(F.abs(F.col("want") - F.col("got")) == 1, 1).otherwise(0).alias("relevance"), F.col("got").alias("source"))
    made = R.ir_metrics(judged)
    return made.select("query_id", *(F.round(c, 6).alias(c) for c in ("precision_at_k", "reciprocal_rank", "ndcg", "diversity")))


LISTS = f"""{BM25}, a AS (SELECT query_id, 'lexical' AS list, doc_id AS id, rank FROM o WHERE rank <= 20),
t2 AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2)) AS term FROM documents), f2 AS (SELECT doc_id, term, count(*) AS tf FROM t2 GROUP BY ALL), z2 AS (SELECT doc_id, sum(tf) AS size FROM f2 GROUP BY doc_id),
s2 AS (SELECT f2.doc_id, CAST('0x' || substr(sha256(f2.term), 1, 8) AS BIGINT) AS idx, round(sum(f2.tf::DOUBLE / z2.size), 6) AS val FROM f2 JOIN z2 ON f2.doc_id = z2.doc_id GROUP BY ALL),
h2 AS (SELECT query_id, CAST('0x' || substr(sha256(term), 1, 8) AS BIGINT) AS idx, count(*)::DOUBLE AS w FROM q GROUP BY ALL), r2 AS (SELECT query_id, doc_id, sum(val * w) AS score FROM s2 JOIN h2 ON s2.idx = h2.idx GROUP BY ALL),
b AS (SELECT query_id, 'sparse' AS list, doc_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r2) WHERE rank <= 20),
l AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def lists_of(t):
    from tidewire.operators import corpus as C

    return C.lexical_and_sparse(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 20)


@query(f"""WITH {LISTS}, g AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM g)
SELECT query_id, id, round(score, 8) AS score, rank FROM n WHERE rank <= 15""")
def hybrid_rrf(t):
    return R.fused(lists_of(t), 60, 15).withColumn("score", F.round("score", 8))


@query(f"WITH {LISTS}, u AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY list, rank) AS rn FROM l) SELECT query_id, id, list, rank AS position FROM u WHERE rn = 1")
def union_dedup(t):
    return R.merged(lists_of(t).withColumnRenamed("rank", "position")).select("query_id", "id", "list", "position")


HITS = "h AS (SELECT l_suppkey AS query_id, l_orderkey AS news_id, l_linenumber AS seq, l_quantity AS score FROM lineitem)"


def hits_of(t):
    return t.lineitem.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("news_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("score"))


@query(f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, news_id ORDER BY score DESC, seq) AS rn FROM h), b AS (SELECT * FROM r WHERE rn = 1) SELECT query_id, news_id, seq, score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS norm FROM b")
def best_chunk_normalised(t):
    return R.normalised(R.best_per_article(hits_of(t))).withColumn("norm", F.round("norm", 6))


@query(f"""WITH {HITS}, r AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, news_id ORDER BY score DESC, seq) = 1 AS f FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, f ORDER BY score DESC, seq, news_id) AS place FROM r) SELECT query_id, count(*) AS hits, count(*) FILTER (n <= 12 OR (f AND place <= 12)) AS reranked FROM p GROUP BY query_id""")
def rerank_split(t):
    return R.rerank_split(hits_of(t), 12).groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if("to_rerank").alias("reranked"))


@query("""WITH x AS (SELECT l_orderkey AS id, l_linenumber AS line, l_discount * 10 AS rerank, l_quantity / 50 AS retrieval, l_tax * 12 AS trust, l_linenumber % 6 + 1 AS grade, exp(-ln(2) * greatest(date_diff('day', l_shipdate, TIMESTAMP '1998-12-01') * 24.0, 0) / CASE l_returnflag WHEN 'A' THEN 720.0 WHEN 'N' THEN 168.0 ELSE 24.0 END) AS fresh,
CASE WHEN l_linestatus = 'O' THEN 'title' ELSE 'body' END AS zone, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax * 10 END AS value, l_discount * 9 AS match FROM lineitem),
y AS (SELECT *, CASE WHEN abs(rerank - 0.5) < 0.01 THEN 0.80 * least(greatest(retrieval, 0), 1) + 0.20 * rerank ELSE 0.70 * rerank + 0.30 * least(greatest(retrieval, 0), 1) END AS relevance FROM x),
z AS (SELECT *, 0.50 * relevance + 0.20 * trust + 0.15 * (1.0 - (grade - 1) / 5.0) + 0.15 * fresh AS raw FROM y),
w AS (SELECT *, least(1.0, CASE WHEN value IS NULL THEN raw ELSE 0.80 * raw + 0.20 * least(greatest(value, 0), 1) END * CASE WHEN match < 0.05 OR zone <> 'title' THEN 1.0 ELSE 1.2 END) AS s FROM z)
SELECT id, line, round(least(1.0, (0.86 * s + 0.14 * least(greatest(match, 0), 1)) * CASE WHEN abs(rerank - 0.5) < 0.01 AND match < 0.20 THEN 0.92 ELSE 1.0 END), 4) AS score FROM w""")
def final_score_blend(t):
    c = F.col
    kind = F.when(c("l_returnflag") == "A", "reference").when(c("l_returnflag") == "N", "analytics").otherwise("daily")
    fresh = S.decay(F.datediff(F.lit("1998-12-01").cast("date"), "l_shipdate") * 24.0, kind)
    score = S.final_score(c("l_discount") * 10, c("l_quantity") / 50, c("l_tax") * 12, c("l_linenumber") % 6 + 1, fresh, F.when(c("l_linestatus") == "O", "title").otherwise("body"), F.when(c("l_linenumber") != 3, c("l_tax") * 10), c("l_discount") * 9)
    return t.lineitem.select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), F.round(score, 4).alias("score"))


TERMS4 = "q AS (SELECT item_id, text AS query, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 3)) AS terms FROM benchmark)"


@query(f"""WITH {TERMS4}, {BM25.replace('q AS (SELECT DISTINCT', 'q0 AS (SELECT DISTINCT').replace('FROM q)', 'FROM q0)').replace('JOIN q ON', 'JOIN q0 q ON').replace('m AS (SELECT avg', 'm0 AS (SELECT avg').replace('doc_id, m)', 'doc_id, m0)')},
h AS (SELECT q.item_id, d.doc_id, query, terms, d.text, lower(substr(d.text, 1, 80)) AS title, lower(substr(d.text, 1, 280)) AS lead, lower(source) AS meta, lower(substr(d.text, 1, 4000)) AS body FROM o JOIN q ON item_id = query_id JOIN documents d ON d.doc_id = o.doc_id WHERE rank <= 20),
m AS (SELECT item_id, doc_id, 0.42::DOUBLE * (len(list_filter(terms, lambda t: contains(title, t)))::DOUBLE / len(terms)) + 0.24::DOUBLE * (len(list_filter(terms, lambda t: contains(lead, t)))::DOUBLE / len(terms)) + 0.22::DOUBLE * (len(list_filter(terms, lambda t: contains(meta, t)))::DOUBLE / len(terms))
+ 0.12::DOUBLE * (len(list_filter(terms, lambda t: contains(body, t)))::DOUBLE / len(terms)) + CASE WHEN length(query) >= 8 AND contains(title || ' ' || lead, lower(query)) THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END
+ CASE WHEN len(list_filter(terms, lambda t: regexp_full_match(t, '[0-9]+') AND (contains(title || ' ' || lead, t) OR contains(text, t)))) > 0 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END AS s FROM h) SELECT item_id, doc_id, round(least(1.0::DOUBLE, s), 6) AS match FROM m""")
def query_match_scores(t):
    """Each query's twenty best documents by full text, scored by how its words lie in them: matching is a step after retrieval."""
    from tidewire.operators import corpus as C

    q = t.benchmark.select("item_id", F.col("text").alias("query"), F.array_distinct(T.words(F.col("text"), 3)).alias("terms"))
    found = C.bm25(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 20).select(F.col("query_id").alias("item_id"), "doc_id")
    rows = found.join(q, "item_id").join(t.documents, "doc_id")
    score = S.query_match(F.col("terms"), F.col("query"), F.substring("text", 1, 80), F.substring("text", 1, 280), F.col("source"), F.col("text"))
    return rows.select("item_id", "doc_id", F.round(score, 6).alias("match"))


@query("""SELECT l_returnflag AS mode, count(*) AS runs, CAST(floor(sum(l_linenumber) / count(*)) AS BIGINT) AS latency, round((count(*) FILTER (l_tax > 0.04))::DOUBLE / count(*), 6) AS high_share, round(avg(l_quantity), 4) AS words FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL""")
def mode_summary(t):
    rows = t.lineitem.where("l_linestatus = 'O'").groupBy(F.col("l_returnflag").alias("mode"))
    return rows.agg(F.count("*").alias("runs"), F.floor(F.sum("l_linenumber") / F.count("*")).alias("latency"), F.round(F.count_if(F.col("l_tax") > 0.04) / F.count("*"), 6).alias("high_share"), F.round(F.avg("l_quantity"), 4).alias("words"))


@query("""WITH m AS (SELECT l_suppkey AS item, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS b FROM lineitem GROUP BY ALL) SELECT item, round(b - a, 6) AS delta FROM m""")
def mode_deltas(t):
    wide = t.lineitem.groupBy(F.col("l_suppkey").alias("item")).pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_quantity"))
    return wide.select("item", F.round(F.col("R") - F.col("A"), 6).alias("delta"))


@query("""WITH u AS (SELECT event_type AS scenario, user_id, value, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS rank FROM events), t AS (SELECT *, event_id % 5 = 0 AS rel, event_id % 17 = 0 AS blk, event_id % 3 = 0 AS seen, event_id % 12 AS topic FROM u WHERE rank <= 10),
a AS (SELECT scenario, avg(hit) AS hit_rate, avg(rr) AS mrr FROM (SELECT scenario, user_id, max(rel::INT) AS hit, coalesce(1.0::DOUBLE / min(CASE WHEN rel THEN rank END), 0) AS rr FROM t GROUP BY ALL) GROUP BY scenario),
b AS (SELECT scenario, (count(*) FILTER (blk))::DOUBLE / count(*) AS be, count(DISTINCT event_id) AS coverage, (count(*) FILTER (seen))::DOUBLE / count(*) AS ss, count(DISTINCT topic) AS topics FROM t GROUP BY scenario)
SELECT a.scenario, round(hit_rate, 6) AS hit_rate, round(mrr, 6) AS mrr, round(be, 6) AS blocked_exposure, coverage, round(ss, 6) AS seen_share, topics FROM a JOIN b ON a.scenario = b.scenario""")
def personal_metrics(t):
    rows = R.ranked(t.events.select(F.col("event_type").alias("scenario"), "user_id", "value", F.col("event_id").alias("news_id")), ["scenario", "user_id"], [F.desc("value"), F.col("news_id")])
    i = F.col("news_id")
    made = R.personal_metrics(rows.select("scenario", "user_id", "rank", "news_id", (i % 5 == 0).alias("relevant"), (i % 17 == 0).alias("blocked"), (i % 3 == 0).alias("seen"), (i % 12).alias("topic")))
    return made.select("scenario", *(F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "blocked_exposure", "seen_share")), "coverage", "topics")
