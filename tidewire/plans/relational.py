"""Relational queries: orders as articles, customers and nations as sources, lineitem as the bridge to entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import relational as R
from tidewire.plans.registry import query
from tidewire.sources import store


def articles(t):
    """Articles with their source, topic and date; dimensions are small and joined by Spark's choice."""
    c = t.customer.select(F.col("c_custkey"), F.col("c_nationkey"))
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@query("""SELECT news_id, title, topic, published, total FROM (SELECT o_orderkey AS news_id, n_name AS title, r_name AS topic, o_orderdate AS published, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31' AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 = 0)) ORDER BY published DESC NULLS LAST, news_id DESC LIMIT 20 OFFSET 40""")
def news_feed_page(t):
    rows = articles(t).select(F.col("o_orderkey").alias("news_id"), F.col("n_name").alias("title"), F.col("r_name").alias("topic"), F.col("o_orderdate").alias("published"), F.col("c_nationkey").alias("source_id"))
    where = [F.col("topic").isin("ASIA", "EUROPE"), F.col("published").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))]
    page = R.feed(rows, [F.desc_nulls_last("published"), F.desc("news_id")], 40, 20, where, t.nation.where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("source_id")))
    return page.select("news_id", "title", "topic", "published", "total")


@query("SELECT o_orderkey AS news_id, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS urgency FROM orders WHERE o_orderstatus = 'O' ORDER BY urgency, o_orderdate, o_orderkey LIMIT 24")
def processing_batch(t):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("news_id"), rank.alias("urgency"), "o_orderdate").orderBy("urgency", "o_orderdate", "news_id").limit(24).select("news_id", "urgency")


@query("SELECT r_name AS topic, o_orderstatus AS status, count(*) AS articles, count(DISTINCT c_nationkey) AS sources, round(avg(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def topic_counts(t):
    return articles(t).groupBy(F.col("r_name").alias("topic"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("articles"), F.countDistinct("c_nationkey").alias("sources"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("SELECT o_orderkey AS news_id, o_totalprice AS price FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49) AND o_orderstatus = 'F'")
def semi_exists(t):
    big = t.lineitem.where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus = 'F'").join(big, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("news_id"), F.col("o_totalprice").alias("price"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS rn FROM lineitem), l AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY rn) AS entities FROM r WHERE rn <= 5 GROUP BY l_orderkey)
SELECT o_orderkey AS news_id, coalesce(entities, '') AS entities FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def lateral_array(t):
    lists = R.top_lists(t.lineitem, "l_orderkey", "l_partkey", [F.desc("l_quantity"), F.col("l_partkey"), F.col("l_linenumber")], 5)
    return t.orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("news_id"), F.coalesce(F.array_join(F.col("values").cast("array<string>"), ","), F.lit("")).alias("entities"))


@query("WITH r AS (SELECT l_suppkey AS source, l_partkey AS entity, l_orderkey AS news_id, l_extendedprice AS weight, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT * FROM r WHERE rank <= 8")
def topk_per_key(t):
    from tidewire.operators.retrieval import ranked

    rows = ranked(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 8)
    return rows.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("news_id"), F.col("l_extendedprice").alias("weight"), "rank")


@query("""SELECT 'orders without lines' AS kind, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'lines without orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'customers without orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphan_checks(t):
    def count(kind, left, right, on):
        return R.orphans(left, right, on).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))

    made = count("orders without lines", t.orders, t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    made = made.union(count("lines without orders", t.lineitem, t.orders, F.col("o_orderkey") == F.col("l_orderkey")))
    return made.union(count("customers without orders", t.customer, t.orders, F.col("c_custkey") == F.col("o_custkey")))


@query("SELECT coalesce(a, b) AS id, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'orphan' ELSE 'ok' END AS status FROM (SELECT DISTINCT o_orderkey AS a FROM orders WHERE o_orderkey % 10 < 8) x FULL JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem WHERE l_orderkey % 10 > 1) y ON a = b")
def reconcile_sets(t):
    return R.reconciled(t.orders.where("o_orderkey % 10 < 8").select(F.col("o_orderkey").alias("id")), t.lineitem.where("l_orderkey % 10 > 1").select(F.col("l_orderkey").alias("id")), "id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set_except(t):
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).exceptAll(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()).distinct()


@query("""SELECT u.user_id, coalesce(a, 0) AS clicks, coalesce(b, 0) AS views, coalesce(c, 0) AS errors FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) AS a FROM events WHERE event_type = 'click' GROUP BY 1) x ON u.user_id = x.user_id
LEFT JOIN (SELECT user_id, count(*) AS b FROM events WHERE event_type = 'view' GROUP BY 1) y ON u.user_id = y.user_id LEFT JOIN (SELECT user_id, count(*) AS c FROM events WHERE event_type = 'error' GROUP BY 1) z ON u.user_id = z.user_id""")
def user_fact_counts(t):
    of = lambda kind: t.events.where(F.col("event_type") == kind)
    return R.fact_counts(t.events.select("user_id").distinct(), "user_id", {"clicks": of("click"), "views": of("view"), "errors": of("error")})


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE lower(c_name) = 'customer#000000007' OR c_custkey = 11 OR lower(c_mktsegment) LIKE 'auto%' AND c_acctbal < -900")
def lookup_ci(t):
    return t.customer.where((F.lower("c_name") == "customer#000000007") | (F.col("c_custkey") == 11) | (F.lower("c_mktsegment").startswith("auto") & (F.col("c_acctbal") < -900))).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("WITH u AS (SELECT o_custkey AS k, o_orderdate AS v, o_orderkey AS id, o_totalprice AS x FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, CASE WHEN id % 2 = 1 THEN 1 ELSE 0 END DESC, id DESC) AS rn FROM u) SELECT k, v, x FROM r WHERE rn = 1")
def upsert_latest(t):
    from tidewire.operators.retrieval import ranked

    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("v"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"))
    one = lambda df: ranked(df, ["k"], [F.desc("v"), F.desc("id")], 1, "_r").drop("_r")
    return store.upsert(one(rows.where("id % 2 = 0")), one(rows.where("id % 2 = 1")), "k", "v").select("k", "v", "x")


@query("WITH b AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderkey % 2 = 1) SELECT k, id FROM b WHERE rn = 1 AND k NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 16 = 0)")
def insert_dedup(t):
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"))
    return store.insert_new(rows.where("id % 16 = 0"), rows.where("id % 2 = 1"), "k", [F.col("d"), F.col("id")]).select("k", "id")


@query("SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY) AS deleted, count(*) AS total FROM orders")
def retention_dry_run(t):
    return store.retained(t.orders, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), 90)[1]


@query("""WITH f AS (SELECT c_nationkey AS source, o_orderkey, o_orderdate AS ts, 'u' || o_orderkey AS url, o_orderkey % 50 = 3 AS known FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, url DESC) AS rn, count(*) FILTER (known) OVER (PARTITION BY source) AS duplicates FROM f),
s AS (SELECT *, min(CASE WHEN known THEN rn END) OVER (PARTITION BY source) AS stop FROM r) SELECT source, url, duplicates FROM s WHERE stop IS NULL OR rn < stop""")
def feed_stop_early(t):
    rows = articles(t).select(F.col("c_nationkey").alias("source"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"), (F.col("o_orderkey") % 50 == 3).alias("known"))
    return R.known_until(rows).select("source", "url", "duplicates")


@query("WITH r AS (SELECT c_nationkey AS source, c_mktsegment AS segment, sum(c_acctbal) AS total FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)) SELECT source, segment, round(total, 2) AS total FROM r")
def rollup_balances(t):
    return t.customer.rollup(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
