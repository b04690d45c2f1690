"""Queries over articles: orders as articles of customers' nations, documents as articles with text, lineitem as their entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import plugins
from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators import articles as A
from tidewire.operators import corpus as C
from tidewire.operators import events as E
from tidewire.operators import health as H
from tidewire.plans.corpus import RULE_VALUES, rules_of
from tidewire.plans.events import AS_OF, RUNS, as_of, runs_of
from tidewire.plans.registry import query

STATE = "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'partial' ELSE 'extraction_failed' END"
ARTICLES = f"""a AS (SELECT o_orderkey AS id, c_nationkey AS source, {STATE} AS status, o_orderkey % 3 = 0 AS blank, CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_orderdate END AS published, o_orderdate + INTERVAL (o_orderkey % 48) HOUR AS ingested,
o_orderstatus = 'F' AS processed, 'u' || (o_orderkey % 1000) AS url, o_custkey % 400 AS cluster, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey), e AS (SELECT max(ingested) AS e FROM a)"""


def articles_of(t):
    """Articles, and the newest ingestion as a column ``e``."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "partial").otherwise("extraction_failed")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("id"), F.col("c_nationkey").alias("source"), status.alias("status"), F.when(key % 3 != 0, "text").alias("content"), F.when(key % 10 != 1, day).alias("published"),
        (day + F.make_dt_interval(F.lit(0), (key % 48).cast("int"))).alias("ingested"), (F.col("o_orderstatus") == "F").alias("processed"), F.concat(F.lit("u"), (key % 1000).cast("string")).alias("url"), (F.col("o_custkey") % 400).alias("cluster"), F.col("o_totalprice").alias("price"))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("ingested").alias("e"))))  # one row


@query(f"WITH {ARTICLES} SELECT id, status FROM a WHERE blank AND status IN ('partial', 'extraction_failed') ORDER BY published DESC NULLS LAST, id DESC LIMIT 50")
def pending_enrichment(t):
    return A.pending(articles_of(t), 50).select("id", "status")


@query(f"WITH {ARTICLES} SELECT id FROM a, e WHERE processed AND ingested >= e - INTERVAL 20000 MINUTE ORDER BY ingested DESC, id DESC LIMIT 500")
def recent_processed(t):
    return A.recent(articles_of(t), F.col("e"), 20000).select("id")


@query(f"WITH {ARTICLES} SELECT DISTINCT source, url FROM a, e WHERE ingested >= e - INTERVAL 24 HOUR")
def known_urls(t):
    return A.known_urls(articles_of(t), F.col("e"))


@query("SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 0 THEN 'continuous' WHEN 1 THEN 'periodic' ELSE 'control' END AS priority, row_number() OVER (ORDER BY c_nationkey % 3, c_custkey) AS place FROM customer QUALIFY place <= 100")
def crawl_order(t):
    from pyspark.sql import Window

    p = F.when(F.col("c_nationkey") % 3 == 0, "continuous").when(F.col("c_nationkey") % 3 == 1, "periodic").otherwise("control")
    top = A.crawl_order(t.customer.select(F.col("c_custkey").alias("id"), p.alias("priority"))).limit(100)
    return top.select("id", "priority", F.row_number().over(Window.orderBy("rank", "id")).cast("long").alias("place"))  # 100 rows


@query("""(SELECT 'error' AS kind, event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 5) UNION ALL (SELECT 'log', event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)""")
def latest_errors_and_logs(t):
    rows = t.events.select(F.col("event_id").alias("id"), "ts", "event_type")
    return A.latest(rows, {"error": (F.col("event_type") == "error", 5), "log": (F.lit(True), 20)}).select("kind", "id")


@query(f"WITH {ARTICLES}, n AS (SELECT count(*) AS total FROM a) SELECT id, total, CAST(ceil(total / 15.0) AS BIGINT) AS pages FROM a, n ORDER BY price DESC, id LIMIT 15 OFFSET 30")
def articles_page(t):
    return A.page(articles_of(t), [F.desc("price"), F.col("id")], 3, 15).select("id", "total", "pages")


@query(f"WITH {ARTICLES}, r AS (SELECT x.id, y.id AS other, row_number() OVER (PARTITION BY x.id ORDER BY y.published DESC NULLS LAST, y.id DESC) AS rank FROM a x JOIN a y ON x.cluster = y.cluster AND x.id <> y.id WHERE x.id % 20 = 0) SELECT * FROM r WHERE rank <= 5")
def related_articles(t):
    rows = articles_of(t)
    return A.related(rows, rows.where("id % 20 = 0").select("id"))


@query("SELECT DISTINCT l_orderkey AS news_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 2) AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def entity_articles(t):
    bridge = t.lineitem.select(F.col("l_orderkey").alias("news_id"), F.col("l_partkey").alias("entity"))
    return A.entity_articles(bridge, t.part.where("p_size = 2").select(F.col("p_partkey").alias("entity")), t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("news_id")))


@query("""WITH b AS (SELECT l_suppkey AS key, l_orderkey AS news_id, l_linenumber AS rank, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS part FROM lineitem WHERE l_returnflag IN ('A', 'R')), m AS (SELECT key, news_id, min(part * 100 + rank) AS spot FROM b GROUP BY ALL),
r AS (SELECT key, news_id, row_number() OVER (PARTITION BY key ORDER BY spot, news_id) AS rank FROM m) SELECT * FROM r WHERE rank <= 10""")
def merged_lists(t):
    of = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("news_id"), F.col("l_linenumber").alias("rank"))
    return A.merged_lists(of("A"), of("R"), 10)


LEXICAL = f"""m(topic, position, marker) AS (VALUES {RULE_VALUES}), d AS (SELECT doc_id, lower(substr(text, 1, 1200)) AS low FROM documents), e AS (SELECT *, regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+') AS tokens FROM d),
h AS (SELECT doc_id, topic, position, count(*) AS hits FROM e, m WHERE CASE WHEN length(marker) >= 5 OR contains(marker, ' ') THEN contains(low, marker) ELSE list_contains(tokens, marker) END GROUP BY ALL),
c AS (SELECT *, round(least(0.9, 0.62 + 0.08 * hits)::DOUBLE, 4) AS confidence FROM h), lx AS (SELECT doc_id, topic, confidence FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, position) <= 3),
ru AS (SELECT doc_id, 'source ' || source AS topic, 0.95::DOUBLE AS confidence FROM documents WHERE doc_id % 4 = 0), sc AS (SELECT doc_id, 'lang ' || lang AS topic, round(((doc_id * 7) % 100) / 100.0::DOUBLE, 2) AS score FROM documents),
zs AS (SELECT doc_id, topic, score AS confidence FROM sc WHERE score >= 0.6)"""


def topic_groups(t):
    d = t.documents
    rules = d.where("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("source "), "source").alias("topic"), F.lit(0.95).alias("confidence"))
    scores = d.select("doc_id", F.concat(F.lit("lang "), "lang").alias("topic"), F.round((F.col("doc_id") * 7) % 100 / 100.0, 2).alias("score"))
    return rules, C.lexical_topics(d, rules_of(t)).select("doc_id", "topic", "confidence"), A.zero_shot(scores)


@query(f"WITH {LEXICAL}, g AS (SELECT * FROM ru UNION ALL SELECT * FROM lx UNION ALL SELECT * FROM zs), b AS (SELECT doc_id, topic, max(confidence) AS confidence FROM g WHERE topic IS NOT NULL OR topic IS NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, topic NULLS FIRST) AS rank FROM b) SELECT * FROM r WHERE rank <= 3")
def merged_topics(t):
    rules, lexical, model = topic_groups(t)
    return A.merged_topics(rules.union(lexical).union(model.select("doc_id", "topic", "confidence")))


@query(f"""WITH {LEXICAL} SELECT doc_id, topic, confidence, 'rule' AS origin FROM ru UNION ALL SELECT *, 'lexical' FROM lx WHERE doc_id NOT IN (SELECT doc_id FROM ru) UNION ALL
SELECT *, 'model' FROM zs WHERE doc_id NOT IN (SELECT doc_id FROM ru) AND doc_id NOT IN (SELECT doc_id FROM lx)""")
def resolved_topics(t):
    return A.resolved_topics(*topic_groups(t))


MENTIONS = """s0 AS (SELECT doc_id, regexp_extract_all(' ' || regexp_replace(text, '([^\\p{L}\\p{N}]+)', '  ', 'g') || ' ', ' (\\p{Lu}\\p{Ll}{3,}) ', 1) AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) AS pos FROM s0),
mt AS (SELECT doc_id, lower(text) AS entity, 'name' AS kind, count(*) AS mentions, arg_min(text, pos) AS name FROM s GROUP BY ALL)"""


@query(f"WITH {MENTIONS.replace('GROUP BY ALL', 'GROUP BY doc_id, lower(text)')} SELECT * FROM mt")
def entity_mentions(t):
    return A.entity_mentions(plugins.entities(t.documents))


@query("""WITH x AS (SELECT l_partkey AS entity, CASE WHEN l_linenumber <= 4 THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END - CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS n FROM lineitem) SELECT entity, CAST(greatest(0, sum(n)) AS BIGINT) AS mentions FROM x GROUP BY entity""")
def mention_ledger(t):
    of = lambda rows, n=1: rows.select(F.col("l_partkey").alias("entity"), F.lit(n).cast("long").alias("n"))
    keys = of(t.lineitem, 0).unionByName(of(t.lineitem.where("l_linenumber <= 4")))
    return A.mention_ledger(keys, of(t.lineitem.where("l_returnflag = 'R'"), 2), of(t.lineitem.where("l_returnflag = 'N'")))


@query("""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 4000 END AS cluster, c_nationkey AS source, substr('ABCDEF', c_nationkey % 6 + 1, 1) AS rel FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT cluster, count(DISTINCT source) AS sources FROM a WHERE cluster IS NOT NULL GROUP BY cluster)
SELECT id, a.cluster, sources, CASE WHEN rel IN ('A', 'B') AND sources >= 2 THEN 1 WHEN rel IN ('A', 'B') THEN 2 WHEN rel = 'C' THEN 3 WHEN rel IN ('D', 'E') THEN 4 ELSE 6 END AS grade, rel IN ('D', 'E') AND sources <= 1 AS uncertain, round(least(1.0::DOUBLE, sources / 3.0::DOUBLE), 4) AS support FROM a JOIN n ON a.cluster = n.cluster""")
def cluster_grades(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return A.cluster_grades(rows.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 4000).alias("cluster"), F.col("c_nationkey").alias("source"), F.expr("substr('ABCDEF', c_nationkey % 6 + 1, 1)").alias("reliability")))


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 5 AS s, l_suppkey % 5 AS s2, l_partkey % 7 AS r, l_suppkey % 7 AS r2, l_partkey % 11 AS u, l_suppkey % 11 AS u2 FROM lineitem)
SELECT id, line, CASE WHEN s > 0 AND s = s2 THEN 1.0::DOUBLE WHEN r = r2 OR r IN (u, u2) OR r2 IN (u, u2) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS signal FROM p""")
def external_signals(t):
    text = lambda c: c.cast("string")
    side = lambda p, k: [F.when(F.col(k) % 5 > 0, text(F.col(k) % 5)).otherwise("").alias(f"{p}_story"), F.array(text(F.col(k) % 7)).alias(f"{p}_related"), text(F.col(k) % 11).alias(f"{p}_url")]
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), *side("a", "l_partkey"), *side("b", "l_suppkey"))
    return rows.select("id", "line", A.external_signal("a_", "b_").alias("signal"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.none.deep') AS INT) AS deep FROM events")
def json_props(t):
    number = lambda path: F.get_json_object("props", path).try_cast("int")  # noqa: E731  null where the path or the type isn't there
    return t.events.select(F.col("event_id").alias("id"), number("$.k").alias("k"), number("$.none.deep").alias("deep"))


ZONE = "SELECT doc_id, substr(text, 1, 30) AS title, CASE WHEN doc_id % 3 > 0 THEN substr(text, 1, 60) END AS lead, CASE WHEN doc_id % 5 > 0 THEN text END AS content FROM documents"


@query(f"""WITH z AS ({ZONE}) SELECT doc_id, md5(coalesce(title, '')) AS title_search, md5(coalesce(lead, title, '')) AS title_text, md5(coalesce(content, '') || ' ' || coalesce(lead, '')) AS body_search, md5(coalesce(content, lead, '')) AS body_text,
md5(coalesce(title, '') || ' ' || coalesce(content, '') || ' ' || coalesce(lead, '')) AS all_search, md5(coalesce(content, lead, title, '')) AS all_text FROM z""")
def zone_texts(t):
    title, lead, content = F.substring("text", 1, 30), F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 60)), F.when(F.col("doc_id") % 5 > 0, F.col("text"))
    return t.documents.select("doc_id", *(F.md5(c.cast("binary")).alias(f"{z}_{n}") for z in ("title", "body", "all") for n, c in zip(("search", "text"), T.zone_texts(z, title, lead, content), strict=True)))


@query(f"WITH {ARTICLES} SELECT source, count(*) FILTER (status IN ('ok', 'partial', 'extraction_failed')) AS attempted, count(*) FILTER (status IN ('ok', 'partial')) AS successful, round((count(*) FILTER (status IN ('ok', 'partial')))::DOUBLE / count(*), 4) AS rate FROM a, e WHERE ingested >= e - INTERVAL 240 HOUR GROUP BY source")
def extraction_rates(t):
    return H.extraction_rates(articles_of(t), F.col("e"), 240)


@query(f"WITH {ARTICLES} SELECT source, round(avg((epoch_us(ingested) - epoch_us(published)) / 6e7), 4) AS minutes FROM a, e WHERE ingested >= e - INTERVAL 240 HOUR AND published IS NOT NULL GROUP BY source")
def latency_minutes(t):
    return H.latencies(articles_of(t), F.col("e"), 240)


@query(f"""WITH {ARTICLES}, p AS (SELECT *, CASE WHEN processed THEN ingested + INTERVAL 10 MINUTE END AS done, price / 1000 AS seconds FROM a) SELECT count(*) FILTER (NOT processed) AS pending, greatest(0, (epoch_us(max(e)) - epoch_us(min(CASE WHEN NOT processed THEN ingested END))) / 1e6)::DOUBLE AS oldest_seconds,
count(*) FILTER (processed AND done >= e - INTERVAL 1 HOUR) AS last_hour, round(avg(CASE WHEN processed AND done >= e - INTERVAL 1 HOUR THEN seconds END), 3) AS mean_seconds FROM p, e""")
def backlog_health(t):
    rows = articles_of(t)
    end = rows.agg(F.max("ingested")).first()[0]
    made = rows.select("processed", "ingested", F.when(F.col("processed"), F.col("ingested") + F.expr("INTERVAL 10 MINUTE")).alias("processed_at"), (F.col("price") / 1000).alias("seconds"))
    return H.backlog(made, F.lit(end))


@query(f"""WITH {RUNS}, x AS (SELECT user_id AS source, CASE event_type WHEN 'click' THEN 'partial' WHEN 'error' THEN 'extraction_failed' ELSE 'ok' END AS status, ts FROM events), k2 AS (SELECT source, max(ts) AS latest, max(ts) FILTER (status = 'extraction_failed') IS NOT NULL AS q FROM x GROUP BY source),
ra AS (SELECT source, round((count(*) FILTER (status <> 'extraction_failed'))::DOUBLE / count(*), 4) AS rate FROM x WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY source),
j AS (SELECT h.*, rate, greatest(1.0::DOUBLE, 40 / 15.0::DOUBLE) AS expected, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(latest)) / 3.6e9 AS hours, h.source % 29 = 0 AS recent_4xx, (h.source % 8) / 10.0::DOUBLE AS items_dev, (h.source % 5) / 10.0::DOUBLE AS duplicate_dev FROM h LEFT JOIN ra ON h.source = ra.source LEFT JOIN k2 ON h.source = k2.source),
s AS (SELECT *, hours / expected AS stale, recent_4xx OR failures >= 5 OR coalesce(parse_rate < 0.7, FALSE) OR coalesce(rate < 0.5, FALSE) OR coalesce(hours / expected > 10, FALSE) AS red,
failures BETWEEN 2 AND 4 OR coalesce(parse_rate < 0.95, FALSE) OR coalesce(rate < 0.9, FALSE) OR coalesce(hours / expected > 3, FALSE) OR errors > 5 OR skips > 0 OR items_dev > 0.5 OR duplicate_dev > 0.3 AS yellow FROM j),
ff AS (SELECT *, CASE WHEN red THEN 'red' WHEN yellow THEN 'yellow' ELSE 'green' END AS health FROM s)
SELECT source, health, array_to_string(list_filter([CASE WHEN recent_4xx THEN 'recent_http_4xx' END, CASE WHEN failures >= 5 THEN 'consecutive_failures_red' END, CASE WHEN failures BETWEEN 2 AND 4 THEN 'consecutive_failures_yellow' END, CASE WHEN parse_rate < 0.7 THEN 'parse_success_red' END,
CASE WHEN parse_rate < 0.95 AND parse_rate >= 0.7 THEN 'parse_success_yellow' END, CASE WHEN rate < 0.5 THEN 'extraction_success_red' END, CASE WHEN rate < 0.9 AND rate >= 0.5 THEN 'extraction_success_yellow' END, CASE WHEN stale > 10 THEN 'staleness_red' END, CASE WHEN stale > 3 AND stale <= 10 THEN 'staleness_yellow' END,
CASE WHEN errors > 5 THEN 'http_errors_yellow' END, CASE WHEN skips > 0 THEN 'backpressure_skips_yellow' END, CASE WHEN items_dev > 0.5 THEN 'items_in_feed_deviation_yellow' END, CASE WHEN duplicate_dev > 0.3 THEN 'duplicate_rate_deviation_yellow' END], lambda x: x IS NOT NULL), ',') AS reasons,
round(stale, 4) AS staleness, CASE WHEN health <> 'green' THEN 60 WHEN streak >= 3 THEN 30 ELSE 40 END AS interval FROM ff""")
def source_health_refresh(t):
    facts = t.events.select(F.col("user_id").alias("source"), F.when(F.col("event_type") == "click", "partial").when(F.col("event_type") == "error", "extraction_failed").otherwise("ok").alias("status"), F.col("ts").cast("timestamp").alias("ingested"), F.col("ts").cast("timestamp").alias("published"))
    runs = E.run_health(runs_of(t)).withColumn("recent_4xx", F.col("source") % 29 == 0)
    ids = runs.select("source")
    sources = ids.select("source", F.lit("other").alias("key"), F.lit(40).alias("interval"), F.lit(30).alias("base"))
    return H.refreshed(sources, runs, facts, ids.select("source", ((F.col("source") % 8) / 10.0).alias("items_dev"), ((F.col("source") % 5) / 10.0).alias("duplicate_dev")), as_of().cast("timestamp"))


@query("SELECT event_id AS id, CAST(greatest(30, least(100, 5 * (event_id % 50 + 1))) AS INT) AS candidates, CASE WHEN event_id % 7 = 0 THEN 120 WHEN event_id % 7 IN (1, 2) THEN 1800 WHEN event_id % 7 = 3 THEN 3600 ELSE 300 END AS seconds FROM events")
def search_limits(t):
    i = F.col("event_id")
    kinds = F.when(i % 7 == 0, F.array(F.lit("reference"), F.lit("breaking"))).when(i % 7 == 1, F.array(F.lit("analytics"))).when(i % 7 == 2, F.array(F.lit("reference"), F.lit("analytics"))).when(i % 7 == 3, F.array(F.lit("reference"))).when(i % 7 == 4, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    return t.events.select(i.alias("id"), S.candidate_limit(i % 50 + 1).alias("candidates"), S.cache_seconds(kinds).alias("seconds"))


@query()
def process_articles(t):
    """Chunk payloads of all documents (tested by brute force: sentence windows are loops)."""
    d = t.documents
    lead = T.first_long_line(F.col("text"))
    kind = F.when(F.col("doc_id") % 4 == 0, "breaking").when(F.col("doc_id") % 4 == 1, "daily").when(F.col("doc_id") % 4 == 2, "analytics").otherwise("reference")
    rows = d.select("doc_id", "source", F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.col("text").alias("body"), lead.alias("lead"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("language"), kind.alias("kind"), (F.lit("2024-01-30").cast("timestamp") - F.make_dt_interval(F.lit(0), (F.col("doc_id") % 100).cast("int"))).alias("published"), (F.col("doc_id") % 10 / 10.0).alias("trust"))
    grades = A.cluster_grades(d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 90).alias("cluster"), "source", F.expr("substr('ABCDEF', int(doc_id % 6) + 1, 1)").alias("reliability")))
    mentions = A.entity_mentions(plugins.entities(d)).select("doc_id", "name", "mentions")
    return A.processed(rows, C.lexical_topics(d, rules_of(t)).select("doc_id", "topic", "confidence"), mentions, C.keywords(d).select("doc_id", "term", "rank"), grades, F.lit("2024-01-31").cast("timestamp"))
