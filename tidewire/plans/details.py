"""Queries for single functions and sinks that others don't show: dates, codes, passages, spans, updates, files and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import extract as X
from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators import relational as R
from tidewire.plans.registry import query
from tidewire.sources import store


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 90 MINUTE ELSE INTERVAL 0 MINUTE END END AS published, o_orderkey % 10 = 3 OR o_orderkey % 4 = 1 AS inferred FROM orders")
def feed_dates(t):
    """Dates as feeds write them: with a zone, without one, and garbage."""
    k = F.col("o_orderkey")
    text = F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss")
    raw = F.when(k % 10 == 3, "soon").when(k % 4 == 1, text).when(k % 2 == 0, F.concat(F.lit("Mon, "), text, F.lit(" -0130"))).otherwise(F.concat(text, F.lit(" GMT")))
    when, inferred = T.rfc2822(raw)
    return t.orders.select(k.alias("id"), when.cast("timestamp_ntz").alias("published"), inferred.alias("inferred"))


@query("""SELECT event_id AS id, CASE WHEN c = 429 THEN 'http_429' WHEN c BETWEEN 400 AND 499 THEN 'http_4xx' WHEN c BETWEEN 500 AND 599 THEN 'http_5xx' WHEN event_id % 3 = 0 THEN 'network' ELSE 'unknown' END AS kind, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS odds
FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 429 WHEN event_id % 5 > 0 THEN 400 + event_id % 150 END AS c FROM events)""")
def error_classes(t):
    i = F.col("event_id")
    code = F.when(i % 7 == 0, 429).when(i % 5 > 0, 400 + i % 150)
    return t.events.select(i.alias("id"), S.http_class(code, F.when(i % 3 == 0, "network")).alias("kind"), F.round(S.sigmoid((F.col("value") - 50) / 10), 9).alias("odds"))


SPANS = r"""s AS (SELECT doc_id, text, unnest(string_split_regex(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g'), chr(1))) AS raw, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS i FROM documents),
p AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s),
x AS (SELECT doc_id, i, CAST(off + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS INT) AS start, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS body FROM p)"""


@query(f"WITH {SPANS} SELECT doc_id, start, CAST(start + length(body) AS INT) AS \"end\", body AS text FROM x WHERE body <> ''")
def sentence_spans(t):
    return t.documents.select("doc_id", F.explode(T.sentence_spans(F.col("text"))).alias("s")).select("doc_id", "s.*")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'seg' || c_nationkey ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 5 < 3")
def patched_and_deleted(t):
    """A payload that is set, rows that aren't in the keep-set deleted, and the version published and read through its view."""
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    changes = rows.where("id % 3 = 0").select("id", F.concat(F.lit("seg"), F.col("nation").cast("string")).alias("segment"))
    kept = store.delete_missing(store.patch(rows, changes, "id"), rows.where("id % 5 < 3"), "id")
    base = f"{store.Scratch(t.spark).base}/published"
    store.publish(rows, base, "v1", "published_customers")
    store.publish(kept, base, "v2", "published_customers")
    return t.spark.table("published_customers")


@query("""WITH q AS (SELECT c_custkey AS id, c_custkey % 60 - 2 AS n, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN repeat('x', 501) ELSE c_name END AS query, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS urgency FROM customer)
SELECT id, array_to_string(list_filter([CASE WHEN n BETWEEN 1 AND 50 THEN NULL ELSE 'limit' END, CASE WHEN length(query) BETWEEN 1 AND 500 THEN NULL ELSE 'query' END, CASE WHEN urgency IN ('BUILDING', 'MACHINERY') THEN NULL ELSE 'urgency' END], lambda x: x IS NOT NULL), ',') AS errors FROM q""")
def request_errors(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("id"), (k % 60 - 2).alias("limit"), F.when(k % 11 == 0, "").when(k % 13 == 0, "x" * 501).otherwise(F.col("c_name")).alias("query"), F.when(k % 17 != 0, F.col("c_mktsegment")).alias("urgency"))
    made = R.validated(rows, {"limit": F.col("limit").between(1, 50), "query": F.char_length("query").between(1, 500), "urgency": F.col("urgency").isin("BUILDING", "MACHINERY")})
    return made.select("id", F.array_join("errors", ",").alias("errors"))


@query("""WITH l AS (SELECT l_orderkey AS list_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey) - 1 AS place, l_partkey FROM lineitem) SELECT list_id, place, p_partkey, p_name, coalesce(p_brand, '?') AS brand FROM l JOIN part ON p_partkey = l_partkey WHERE p_size > 10""")
def listed_in_order(t):
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("list_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_linenumber")).alias("m"), "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    return R.in_order(lists, t.part.where("p_size > 10").select("p_partkey", "p_name", F.col("p_brand").alias("brand")), "p_partkey")


@query("""WITH d AS (SELECT c_custkey, 'B' AS reliability, 0.8 AS trust, c_name AS name FROM customer WHERE c_custkey % 4 > 0) SELECT o_orderkey AS id, coalesce(reliability, 'C') AS reliability, coalesce(trust, 0.5)::DOUBLE AS trust, coalesce(name, 'Unknown') AS name FROM orders LEFT JOIN d ON o_custkey = c_custkey""")
def sources_with_defaults(t):
    known = t.customer.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("source"), F.lit("B").alias("reliability"), F.lit(0.8).alias("trust"), F.col("c_name").alias("name"))
    made = R.with_defaults(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source")), known, "source", {"reliability": "C", "trust": 0.5, "name": "Unknown"})
    return made.select("id", "reliability", "trust", "name")


@query("""WITH u AS (SELECT o_custkey AS id, round(avg(o_totalprice), 2) AS balance, CAST(NULL AS VARCHAR) AS segment FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT c_custkey AS id, c_name AS name, CASE WHEN u.id IS NOT NULL THEN u.balance ELSE c_acctbal END AS balance, CASE WHEN u.id IS NOT NULL THEN u.segment ELSE c_mktsegment END AS segment FROM customer LEFT JOIN u ON u.id = c_custkey""")
def updated_from_totals(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    changes = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.avg("o_totalprice"), 2).alias("balance")).withColumn("segment", F.lit(None).cast("string"))
    return R.updated_from(rows, changes, "id", ["balance", "segment"])


@query("""WITH a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 > 0), i AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 > 0) SELECT 'index' AS todo, id FROM a WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT 'delete', id FROM i WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT 'total', (SELECT count(*) FROM a)""")
def reconciliation_repair(t):
    key = t.orders.select(F.col("o_orderkey").alias("id"))
    missing, orphaned, counts = R.repaired(key.where("id % 9 > 0"), key.where("id % 7 > 0"), "id")
    return missing.select(F.lit("index").alias("todo"), "id").union(orphaned.select(F.lit("delete").alias("todo"), "id")).union(counts.select(F.lit("total").alias("todo"), F.col("total").alias("id")))


@query("""SELECT o_orderkey AS news_id, o_orderdate AS published, c_nationkey IN (1, 3) AS preferred FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY published DESC NULLS LAST, o_totalprice DESC, preferred DESC, news_id DESC LIMIT 25 OFFSET 25""")
def feed_with_preferred(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("news_id"), F.col("o_orderdate").alias("published"), "o_totalprice", F.col("c_nationkey").isin(1, 3).alias("preferred"))
    return R.feed(rows, [F.desc_nulls_last("published"), F.desc("o_totalprice"), F.desc("preferred"), F.desc("news_id")], 25, 25).select("news_id", "published", "preferred")


@query("""SELECT l_returnflag AS mode, l_linestatus AS kind, count(*) AS n, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY ALL""")
def results_as_csv(t):
    """Experiment results written as CSV and read back."""
    made = t.lineitem.groupBy(F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("score"))
    path = f"{store.Scratch(t.spark).base}/csv"
    made.coalesce(1).write.option("header", True).csv(path)  # a few rows
    return t.spark.read.schema(made.schema).option("header", True).csv(path)


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'lead ' || doc_id END, ''), substr(text, 1, 280)) AS snippet FROM documents")
def snippets_with_fallback(t):
    lead = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("lead "), F.col("doc_id").cast("string")))
    return t.documents.select("doc_id", X.summary(lead, F.col("text")).alias("snippet"))
