"""Queries over logs, preferences, caches, item parts and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import extract as X
from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators import accounts as A
from tidewire.operators import retrieval as R
from tidewire.plans.registry import query
from tidewire.plans.retrieval import LISTS, lists_of
from tidewire.sources import feeds, store


@query("SELECT conv_id AS search_id, left(text, 500) AS query, left(role || '_' || lpad('', 60, role), 40) AS mode, len(string_split(text, ' ')) AS num_results FROM conversations WHERE turn = 0 AND text IS NOT NULL")
def search_rows(t):
    rows = t.conversations.where("turn = 0 AND text IS NOT NULL").select(F.col("conv_id").alias("search_id"), F.col("text").alias("query"), F.expr("concat(role, '_', lpad('', 60, role))").alias("mode"), F.split("text", " ", -1).alias("results"))
    return A.search_rows(rows).drop("results")


@query("""WITH s AS (SELECT l_orderkey AS search_id, l_partkey AS news_id, min(l_linenumber) AS position, max(l_quantity) AS score FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), c AS (SELECT l_orderkey AS search_id, l_partkey AS news_id, l_linenumber AS ts, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS dwell FROM lineitem WHERE l_returnflag <> 'N'),
k AS (SELECT search_id, news_id, arg_max(dwell, ts * 1000 + dwell) FILTER (dwell IS NOT NULL) AS dwell FROM c GROUP BY ALL) SELECT coalesce(s.search_id, k.search_id) AS search_id, coalesce(s.news_id, k.news_id) AS news_id, position, coalesce(score, 0)::DOUBLE AS score, k.search_id IS NOT NULL AS was_clicked, k.dwell FROM s FULL JOIN k ON s.search_id = k.search_id AND s.news_id = k.news_id""")
def search_clicks(t):
    i = t.lineitem.select(F.col("l_orderkey").alias("search_id"), F.col("l_partkey").alias("news_id"), "l_linenumber", "l_quantity", "l_linestatus", "l_returnflag")
    shown = i.where("l_linestatus = 'O'").groupBy("search_id", "news_id").agg(F.min("l_linenumber").alias("position"), F.max("l_quantity").alias("score"))
    clicks = i.where("l_returnflag <> 'N'").select("search_id", "news_id", F.col("l_linenumber").alias("at"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("dwell"))
    return A.clicked(shown, clicks)


PREFERENCES = """p AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'topic' ELSE 'source' END AS kind, c_nationkey AS item_id, round(c_acctbal, 2) AS weight FROM customer),
s AS (SELECT o_custkey AS user_id, 'topic' AS kind, CAST(o_orderkey % 26 AS INTEGER) AS item_id, round(o_totalprice, 2) AS weight FROM orders WHERE o_orderstatus = 'P'), k AS (SELECT 'topic' AS kind, n_nationkey AS item_id FROM nation), u AS (SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_orderstatus <> 'O'),
b AS (SELECT * FROM s WHERE item_id NOT IN (SELECT item_id FROM k)), g AS (SELECT user_id FROM u WHERE user_id NOT IN (SELECT user_id FROM b))"""


def preferences_of(t):
    own = t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, "topic").otherwise("source").alias("kind"), F.col("c_nationkey").alias("item_id"), F.round("c_acctbal", 2).alias("weight"))
    submitted = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"), F.lit("topic").alias("kind"), (F.col("o_orderkey") % 26).cast("int").alias("item_id"), F.round("o_totalprice", 2).alias("weight"))
    users = t.orders.where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("user_id"))
    return A.replaced_preferences(own, submitted, users, t.nation.select(F.lit("topic").alias("kind"), F.col("n_nationkey").alias("item_id")))


@query(f"WITH {PREFERENCES} SELECT * FROM p WHERE user_id NOT IN (SELECT user_id FROM g) UNION ALL SELECT * FROM s WHERE user_id IN (SELECT user_id FROM g)")
def preferences_replaced(t):
    return preferences_of(t)[0]


@query(f"WITH {PREFERENCES} SELECT * FROM b")
def preferences_refused(t):
    return preferences_of(t)[1]


CACHE = """c AS (SELECT o_orderkey AS key, o_orderdate + INTERVAL (o_orderkey % 7) HOUR AS created, CASE o_orderkey % 4 WHEN 0 THEN 120 WHEN 1 THEN 300 WHEN 2 THEN 1800 ELSE 3600 END * 20000 AS seconds, o_custkey AS news, substr(o_orderpriority, 1, 1) AS topic FROM orders), n AS (SELECT max(created) AS now FROM c),
h AS (SELECT CASE l_returnflag WHEN 'A' THEN 'news' WHEN 'R' THEN 'topic' ELSE 'source' END AS kind, CASE l_returnflag WHEN 'A' THEN CAST(l_suppkey AS VARCHAR) WHEN 'R' THEN CAST(l_orderkey % 15000 + 3 AS VARCHAR) ELSE 'x' END AS value, l_shipdate AS ts FROM lineitem
UNION ALL SELECT 'other', 'y', o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1993-06-01')"""


@query(f"""WITH {CACHE}, f AS (SELECT c.* FROM c, n WHERE epoch_us(now) - epoch_us(created) < seconds::BIGINT * 1000000), e AS (SELECT max(ts) AS e FROM h WHERE kind = 'other'), m AS (SELECT kind, value, max(ts) AS ts FROM h GROUP BY ALL)
SELECT key, seconds FROM f, e WHERE (e IS NULL OR created > e) AND NOT EXISTS (SELECT 1 FROM m WHERE m.ts >= f.created AND (m.kind = 'news' AND m.value = CAST(f.news AS VARCHAR) OR m.kind = 'topic' AND m.value = f.topic))""")
def cache_live(t):
    o, key = t.orders, F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "breaking").when(key % 4 == 1, "daily").when(key % 4 == 2, "analytics").otherwise("reference")
    tag = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    cache = o.select(key.alias("key"), (F.col("o_orderdate") + F.make_dt_interval(hours=(key % 7).cast("int"))).cast("timestamp").alias("created"), (S.cache_seconds(F.array(kind)) * 20000).alias("seconds"), F.array(tag("news", F.col("o_custkey").cast("string")), tag("topic", F.substring("o_orderpriority", 1, 1))).alias("tags"))
    flag = F.col("l_returnflag")
    changes = t.lineitem.select(F.when(flag == "A", "news").when(flag == "R", "topic").otherwise("source").alias("kind"), F.when(flag == "A", F.col("l_suppkey").cast("string")).when(flag == "R", (F.col("l_orderkey") % 15000 + 3).cast("string")).otherwise("x").alias("value"), F.col("l_shipdate").cast("timestamp").alias("at"))
    changes = changes.unionByName(o.where("o_orderdate < TIMESTAMP '1993-06-01'").select(F.lit("other").alias("kind"), F.lit("y").alias("value"), F.col("o_orderdate").cast("timestamp").alias("at")))
    now = cache.agg(F.max("created").alias("now"))
    return A.live(cache.join(F.broadcast(now)), changes, F.col("now")).select("key", "seconds")


@query("SELECT c_custkey AS id, c_name || ' news' AS title, 'https://e.x/' || c_custkey AS url, CASE WHEN c_custkey % 3 = 0 THEN 'https://e.x/r/' || c_custkey END AS related, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS related_title FROM customer")
def item_children(t):
    head = F.concat(F.lit("<item><yandex:full-text>"), F.col("c_name"), F.lit(" news</yandex:full-text><link>https://e.x/"), F.col("c_custkey").cast("string"), F.lit("</link>"))
    links = F.concat(F.lit('<yandex:related><link title="none"/><link url="https://e.x/r/'), F.col("c_custkey").cast("string"), F.lit('">'), F.col("c_mktsegment"), F.lit("</link></yandex:related>"))
    xml = F.concat(head, F.when(F.col("c_custkey") % 3 == 0, links).otherwise(""), F.lit("</item>"))
    rows = t.customer.select(F.col("c_custkey").alias("id"), xml.alias("xml"))
    one = F.get(feeds.related_links(F.col("xml")), F.lit(0))
    return rows.select("id", feeds.child(F.col("xml"), "yandex:full-text").alias("title"), feeds.child(F.col("xml"), "link").alias("url"), one["url"].alias("related"), one["title"].alias("related_title"))


@query(r"""WITH b AS (SELECT page_id, regexp_extract_all(html, '<h[1-6]\b[^>]*>.*?</h[1-6]>|<p\b[^>]*>.*?</p>|<img\b[^>]*>', 0, 'is') AS b FROM pages)
SELECT page_id, len(list_filter(b, lambda x: regexp_matches(x, '^<h', 'i') AND trim(regexp_replace(x, '<[^>]*>|\s', '', 'gs')) <> '')) AS headings, len(list_filter(b, lambda x: regexp_matches(x, '^<p', 'i') AND trim(regexp_replace(x, '<[^>]*>|\s', '', 'gs')) <> '')) AS paragraphs, len(list_filter(b, lambda x: regexp_matches(x, '^<img[^>]*src', 'i'))) AS images FROM b""")
def page_blocks(t):
    made = t.pages.select("page_id", X.blocks(F.col("html")).alias("b"))
    count = lambda k: F.size(F.filter("b", lambda x: x["kind"] == k)).cast("long")
    return made.select("page_id", count("heading").alias("headings"), count("paragraph").alias("paragraphs"), count("image").alias("images"))


@query(r"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, CASE WHEN doc_id % 2 = 0 THEN 500 ELSE 200 END AS least, doc_id % 4 AS blocks, left(text, 300) AS short FROM documents)
SELECT doc_id, CASE WHEN length(coalesce(text, '')) < least THEN 'turbo_too_short' WHEN len(list_filter(l, lambda x: length(regexp_replace(x, '[^0-9A-Za-zА-Яа-яЁё]+', '', 'g')) >= 40)) < 2 THEN 'not_enough_meaningful_paragraphs' WHEN len(list_filter(l, lambda x: length(regexp_replace(x, '[^0-9A-Za-zА-Яа-яЁё]+', '', 'g')) = 0)) > 0 THEN 'punctuation_only_paragraph'
WHEN blocks < 2 THEN 'not_enough_turbo_paragraph_blocks' ELSE 'ok' END AS reason, length(coalesce(text, '')) >= 500 AND length(coalesce(text, '')) >= greatest(length(coalesce(short, '')) * 3, length(coalesce(short, '')) + 400) AS better FROM l""")
def candidate_quality(t):
    text = F.col("text")
    return t.documents.select("doc_id", X.candidate_quality(text, F.when(F.col("doc_id") % 2 == 0, 500).otherwise(200), F.col("doc_id") % 4).alias("reason"), X.fallback_is_better(text, F.left(text, F.lit(300))).alias("better"))


@query(r"""SELECT c_custkey AS id, c_custkey % 5 = 0 AS breaking, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 's' || (c_custkey % 9) END AS section, c_name AS author, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS subtitle,
lower(regexp_replace(c_name, '#', ' ')) AS label, 2 AS tokens, md5('v1|' || lower(c_name) || '|' || c_nationkey) AS cache_key, sha256(c_custkey || '|body|3|m|1') AS point_key FROM customer""")
def item_fields(t):
    c, i = F.col, F.col("c_custkey")
    url = F.concat(F.lit("https://e.x/"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("s"), (i % 9).cast("string"), F.lit("/1?x=2"))))
    title, subtitle = T.title_parts(F.when(i % 2 == 0, F.concat(c("c_name"), F.lit("! // "), c("c_mktsegment"))).otherwise(c("c_name")))
    by = F.when(i % 3 == 0, F.concat(F.lit("desk@e.x ("), c("c_name"), F.lit(")"))).when(i % 3 == 1, F.concat(c("c_name"), F.lit("@e.x"))).otherwise(c("c_name"))
    return t.customer.select(
        i.alias("id"), T.is_breaking(F.when(i % 5 == 0, F.concat(F.lit("Breaking: "), c("c_name"))).otherwise(c("c_name"))).alias("breaking"), T.section(url).alias("section"), T.author(by).alias("author"), title.alias("title"), subtitle.alias("subtitle"),
        T.normal_label(F.concat(F.lit("  "), c("c_name"), F.lit(" !"))).alias("label"), T.token_count(F.concat(c("c_name"), F.lit("  \n x "))).cast("int").alias("tokens"), T.cache_key("v1", F.concat(F.lit(" "), c("c_name")), c("c_nationkey").cast("string")).alias("cache_key"), T.point_key(i, F.lit("body"), F.lit(3), "m", "1").alias("point_key"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
h AS (SELECT doc_id, s, list_filter(s, lambda x: len(list_intersect(regexp_extract_all(lower(x), '[\p{L}\p{N}]+'), ['the', 'der', 'les', 'los'])) > 0) AS h FROM s), o AS (SELECT doc_id, coalesce(h[1], s[1]) AS o FROM h) SELECT doc_id, CASE WHEN length(o) > 200 THEN left(o, 200) || '...' ELSE o END AS snippet FROM o""")
def snippets(t):
    return t.documents.select("doc_id", T.snippet(F.col("text"), F.array(*map(F.lit, ("the", "der", "les", "los")))).alias("snippet"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, round(l_tax * 10 * exp(-ln(2) * (l_quantity / CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 24.0::DOUBLE END)) * CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * least(1.0::DOUBLE, l_linenumber / 3.0::DOUBLE), 6) AS value,
round(0.62::DOUBLE * l_tax * 10 + 0.33::DOUBLE * least(1.0::DOUBLE, l_quantity / 40) + CASE WHEN l_returnflag = 'R' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 6) AS selection, CASE WHEN l_discount * 10 < 0.45 THEN 'LOW' ELSE ['LOW', 'MEDIUM', 'HIGH', 'TOP'][least(l_linenumber % 4, l_orderkey % 4) + 1] END AS confidence FROM lineitem""")
def item_scores(t):
    c = F.col
    label = lambda i: F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "TOP"))), (i % 4 + 1).cast("int"))
    value = S.value_score(c("l_tax") * 10, c("l_quantity"), c("l_returnflag") == "A", c("l_linestatus") == "O", c("l_linenumber"))
    return t.lineitem.select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), F.round(value, 6).alias("value"), F.round(S.selection_score(c("l_tax") * 10, c("l_quantity") / 40, c("l_returnflag") == "R"), 6).alias("selection"), S.capped_confidence(label(c("l_linenumber")), label(c("l_orderkey")), c("l_discount") * 10).alias("confidence"))


@query("SELECT e.vec_id AS id, round(least(1, greatest(0, (list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) + 1) / 2)), 6) AS affinity FROM embeddings e JOIN embeddings q ON q.vec_id = e.label")
def embedding_affinity(t):
    own = t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("a"))
    return own.join(t.embeddings.select(F.col("vec_id").alias("label"), F.col("embedding").alias("b")), "label").select("id", F.round(S.cosine01(F.col("a"), F.col("b")), 6).alias("affinity"))


@query("""SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31' AND c_nationkey IN (1, 3, 5, 7, 9, 11) AND o_orderkey % 6 + 1 <= 4 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R'))""")
def filtered_articles(t):
    topics = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("topics"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("language"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.col("c_nationkey").alias("source_id"), (F.col("o_orderkey") % 6 + 1).alias("content_grade"))
    at = lambda day: F.lit(day).cast("timestamp")
    return R.filtered(rows.join(topics, "id"), language="F", start=at("1994-01-01"), end=at("1997-12-31"), sources=(1, 3, 5, 7, 9, 11), topics=("A", "R"), grade_max=4).select("id")


@query("SELECT coalesce(s_name, 'Supplier#' || lpad(CAST(i AS VARCHAR), 9, '0')) AS name, CASE WHEN i IS NULL THEN CAST(s_suppkey AS INTEGER) % 60 + 1 ELSE 15 + i END AS interval, i IS NOT NULL AS seeded FROM supplier FULL JOIN (SELECT unnest(range(5, 23)) AS i) ON s_name = 'Supplier#' || lpad(CAST(i AS VARCHAR), 9, '0')")
def seeded_sources(t):
    """Sources after eighteen seed rows were put in by name."""
    seeds = t.spark.createDataFrame([(f"Supplier#{i:09d}", 15 + i) for i in range(5, 23)], "name string, interval int")
    own = t.supplier.select(F.col("s_name").alias("name"), (F.col("s_suppkey").cast("int") % 60 + 1).alias("interval"), F.lit(False).alias("seeded"), F.lit(0).alias("version"))
    return store.upsert(own, seeds.withColumn("seeded", F.lit(True)).withColumn("version", F.lit(1)), "name", "version").select("name", F.col("interval").cast("long").alias("interval"), "seeded")


@query(f"""WITH {LISTS}, g AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM l GROUP BY ALL), j0 AS (SELECT query_id, 'hybrid' AS list, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM g),
j1 AS (SELECT query_id, list, id, rank FROM l UNION ALL SELECT query_id, list, id, rank FROM j0 WHERE rank <= 20), j AS (SELECT j1.query_id, list, rank, CASE WHEN contains(d.text, left(b.text, 40)) THEN 2 WHEN d.lang = 'en' THEN 1 ELSE 0 END AS relevance, d.source FROM j1 JOIN documents d ON d.doc_id = j1.id JOIN benchmark b ON b.item_id = j1.query_id),
j2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY relevance DESC, rank) AS ir FROM j), j3 AS (SELECT query_id, list, sum((2.0::DOUBLE ** relevance - 1) / log2(ir + 1)) AS ideal FROM j2 WHERE ir <= 10 GROUP BY ALL)
SELECT j.list AS mode, j.query_id, round((count(*) FILTER (relevance > 0)) / 10.0::DOUBLE, 6) AS precision_at_10, round(coalesce(1.0::DOUBLE / min(CASE WHEN relevance > 0 THEN rank END), 0), 6) AS mrr, round(coalesce(sum((2.0::DOUBLE ** relevance - 1) / log2(rank + 1)) / nullif(max(ideal), 0), 0), 6) AS ndcg, round(count(DISTINCT source)::DOUBLE / count(*), 6) AS diversity
FROM j JOIN j3 ON j.query_id = j3.query_id AND j.list = j3.list WHERE rank <= 10 GROUP BY ALL""")
def retrieval_modes(t):
    """Lexical, sparse and fused lists beside each other, with the metrics of each query."""
    lists = store.settle(lists_of(t))  # read twice
    both = lists.unionByName(R.fused(lists, 60, 20).select("query_id", F.lit("hybrid").alias("list"), "id", "rank"))
    rows = both.join(t.documents.select(F.col("doc_id").alias("id"), "text", "lang", "source"), "id").join(t.benchmark.select(F.col("item_id").alias("query_id"), F.left("text", F.lit(40)).alias("start")), "query_id")
    relevance = F.when(F.contains("text", "start"), 2).when(F.col("lang") == "en", 1).otherwise(0)
    made = R.ir_metrics(rows.select(F.struct("list", "query_id").alias("query_id"), "rank", relevance.alias("relevance"), "source"))
    return made.select(F.col("query_id.list").alias("mode"), F.col("query_id.query_id").alias("query_id"), F.round("precision_at_k", 6).alias("precision_at_10"), F.round("reciprocal_rank", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), F.round("diversity", 6).alias("diversity"))
