"""Queries over dated facts: events (runs, mentions), orders (articles), customers (sources)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.operators import clustering as C
from tidewire.operators import events as E
from tidewire.plans.registry import query
from tidewire.sources.store import Scratch

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


PROFILES = f"""p AS (SELECT user_id AS entity, CAST(coalesce(sum(1) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY), 0) AS DOUBLE) AS current,
round(coalesce(sum(1) FILTER (ts < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY), 0)::DOUBLE / 30.0::DOUBLE, 4) AS baseline, count(DISTINCT CASE WHEN ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN event_type END) AS sources
FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 31 DAY AND ts < TIMESTAMP '{AS_OF}' GROUP BY user_id)"""


def profiles(t):
    return E.entity_profiles(t.events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("source"), F.lit(1).alias("n"), "ts"), as_of())


@query(f"""WITH {PROFILES} SELECT *, CASE WHEN baseline <= 0 THEN CASE WHEN current >= 3 AND sources >= 2 THEN 'ascending' ELSE 'stable' END
WHEN current / baseline >= 1.25 AND current >= 3 AND sources >= 2 THEN 'ascending' WHEN current / baseline <= 0.75 THEN 'descending' ELSE 'stable' END AS trend FROM p""")
def entity_profiles(t):
    return profiles(t)


for _name, _factor in (("entity_trending", 1.5), ("entity_spikes", 2.0)):
    query(f"WITH {PROFILES} SELECT entity, current, baseline, round(current - baseline, 4) AS gain FROM p WHERE current > {_factor} * baseline", name=_name)(lambda t, f=_factor: E.rising(profiles(t), f).select("entity", "current", "baseline", "gain"))

STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END"
RUNS = f"""r AS (SELECT user_id AS source, event_id AS run, ts, {STATUS} AS status, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, run DESC) AS rn FROM r), k AS (SELECT * FROM n WHERE rn <= 10),
f AS (SELECT *, min(CASE WHEN status = 'success' THEN rn END) OVER (PARTITION BY source) AS fg, min(CASE WHEN status <> 'success' THEN rn END) OVER (PARTITION BY source) AS fo FROM k),
h AS (SELECT source, count(*) AS runs, (count(*) FILTER (status = 'success'))::DOUBLE / nullif(count(*) FILTER (status <> 'skipped'), 0) AS parse_rate, CAST(sum(errors) AS BIGINT) AS errors, count(*) FILTER (status = 'skipped') AS skips,
coalesce(max(fo) - 1, count(*)) AS streak, count(*) FILTER (status = 'failed' AND (fg IS NULL OR rn < fg)) AS failures FROM f GROUP BY source)"""


def runs_of(t):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("success")
    return t.events.select(F.col("user_id").alias("source"), F.col("event_id").alias("run"), "ts", status.alias("status"), (F.col("event_type") == "error").cast("int").alias("errors"))


@query(f"""WITH {RUNS} SELECT source, runs, round(parse_rate, 6) AS parse_rate, errors, skips, streak, failures,
CASE WHEN failures >= 5 OR parse_rate < 0.7 THEN 'red' WHEN failures >= 2 OR parse_rate < 0.95 OR errors > 5 OR skips > 0 THEN 'yellow' ELSE 'green' END AS health,
array_to_string(list_filter([CASE WHEN failures >= 5 THEN 'consecutive_failures_red' WHEN failures >= 2 THEN 'consecutive_failures_yellow' END, CASE WHEN parse_rate < 0.7 THEN 'parse_success_red' WHEN parse_rate < 0.95 THEN 'parse_success_yellow' END,
CASE WHEN errors > 5 THEN 'http_errors_yellow' END, CASE WHEN skips > 0 THEN 'backpressure_skips_yellow' END], lambda x: x IS NOT NULL), ',') AS reasons FROM h""")
def source_run_health(t):
    rows = E.run_health(runs_of(t))
    none = F.lit(None).cast("double")
    status, reasons = S.health(F.col("failures"), F.col("parse_rate"), none, none, F.lit(False), F.col("errors"), F.col("skips"), none, none)
    return rows.select("source", "runs", F.round("parse_rate", 6).alias("parse_rate"), "errors", "skips", "streak", "failures", status.alias("health"), F.array_join(reasons, ",").alias("reasons"))


@query(f"""WITH r AS (SELECT user_id AS source, {STATUS} AS status, event_type FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND ts < TIMESTAMP '{AS_OF}')
SELECT source, count(*) AS runs, count(*) FILTER (status <> 'skipped') AS attempted, round((count(*) FILTER (status = 'success'))::DOUBLE / nullif(count(*) FILTER (status <> 'skipped'), 0), 6) AS parse_rate, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (status = 'skipped') AS skips FROM r GROUP BY source""")
def run_diagnostics_24h(t):
    rows = runs_of(t).where((F.col("ts") >= as_of() - F.expr("INTERVAL 1 DAY")) & (F.col("ts") < as_of()))
    made = E.conditional_counts(rows, "source", {"runs": F.lit(True), "attempted": F.col("status") != "skipped", "good": F.col("status") == "success", "errors": F.col("errors") > 0, "skips": F.col("status") == "skipped"})
    return made.select("source", "runs", "attempted", F.round(F.col("good") / F.nullif("attempted", F.lit(0)), 6).alias("parse_rate"), "errors", "skips")


@query("""WITH d AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS value FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS rn FROM d),
m AS (SELECT source, CAST(max(CASE WHEN rn = 1 THEN value END) AS DOUBLE) AS latest, quantile_cont(CASE WHEN rn > 1 THEN value END, 0.5) AS median FROM n WHERE rn <= 30 GROUP BY source)
SELECT source, latest, CAST(median AS DOUBLE) AS median, round((latest - median) / nullif(median, 0), 6) AS deviation FROM m""")
def feed_deviation_median(t):
    return E.median_deviation(t.events.groupBy(F.col("event_type").alias("source"), F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("value")))


@query("""WITH a AS (SELECT o_orderpriority AS source, o_orderdate AS published, o_orderdate + INTERVAL (o_orderkey % 30 - 2) HOUR AS ingested, o_orderkey % 9 = 0 AS inferred FROM orders), m AS (SELECT max(ingested) AS e FROM a),
g AS (SELECT source, count(*) AS items, min(published) AS oldest, max(published) AS newest, CAST(round(avg((epoch_us(ingested) - epoch_us(published)) / 3.6e9)) AS BIGINT) AS hours_behind, count(*) FILTER (published > ingested) AS items_in_future,
count(*) FILTER (inferred) AS items_inferred, round((count(*) FILTER (inferred))::DOUBLE / nullif(count(*), 0), 3) AS inferred_ratio FROM a, m WHERE ingested > e - INTERVAL 1 DAY AND ingested <= e GROUP BY source)
SELECT *, CASE WHEN items_in_future > 0 THEN 'high' WHEN inferred_ratio > 0.10 THEN 'medium' ELSE 'ok' END AS flag FROM g""")
def date_audit(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("timestamp").alias("published"), F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, cast(o_orderkey % 30 - 2 as int))").alias("ingested"), (F.col("o_orderkey") % 9 == 0).alias("inferred"))
    last = rows.agg(F.max("ingested").alias("e"))
    rows = rows.crossJoin(F.broadcast(last))  # one row
    made = E.date_audit(rows, F.col("e"))
    return made.withColumn("oldest", F.col("oldest").cast("timestamp_ntz")).withColumn("newest", F.col("newest").cast("timestamp_ntz"))


ITEMS = "i AS (SELECT o_orderkey AS id, c_nationkey AS source, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 400 END AS cluster, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH {ITEMS}, s AS (SELECT cluster, count(DISTINCT source) AS sources FROM i WHERE cluster IS NOT NULL GROUP BY cluster), m AS (SELECT max(ts) AS e FROM i)
SELECT source, count(*) AS items, count(*) FILTER (coalesce(sources, 1) <= 1) AS unique_items, round((count(*) FILTER (coalesce(sources, 1) <= 1))::DOUBLE / count(*), 4) AS utility
FROM i LEFT JOIN s ON i.cluster = s.cluster, m WHERE ts >= e - INTERVAL 30 DAY AND ts < e GROUP BY source""")
def source_utility(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("source"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 400).alias("cluster"), F.col("o_orderdate").alias("ts"))
    return E.source_utility(rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("e")))), F.col("e"))


@query("""WITH n AS (SELECT n_nationkey, n_name, count(o_orderkey) AS items, count(o_orderkey) FILTER (o_orderstatus = 'F') AS done, count(o_orderkey) FILTER (o_orderstatus = 'P') AS partial FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
h AS (SELECT *, round(done::DOUBLE / nullif(items, 0), 4) AS rate FROM n), c AS (SELECT *, CASE WHEN rate IS NULL OR rate < 0.45 THEN 'red' WHEN rate < 0.5 THEN 'yellow' ELSE 'green' END AS health FROM h)
SELECT n_name AS name, items, done, partial, rate, health, row_number() OVER (ORDER BY CASE health WHEN 'red' THEN 1 WHEN 'yellow' THEN 2 ELSE 3 END, n_name) AS position FROM c""")
def health_dashboard(t):
    from pyspark.sql import Window

    facts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    counts = E.conditional_counts(facts, "c_nationkey", {"items": F.lit(True), "done": F.col("o_orderstatus") == "F", "partial": F.col("o_orderstatus") == "P"})
    rows = t.nation.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("name"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "done", "partial")))
    rows = rows.withColumn("rate", F.round(F.col("done") / F.nullif("items", F.lit(0)), 4)).withColumn("health", F.when(F.col("rate").isNull() | (F.col("rate") < 0.45), "red").when(F.col("rate") < 0.5, "yellow").otherwise("green"))
    order = F.when(F.col("health") == "red", 1).when(F.col("health") == "yellow", 2).otherwise(3)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(order, "name")).cast("long"))  # one row a source


@query(f"""SELECT count(*) FILTER (event_type IN ('view', 'click')) AS green, count(*) FILTER (event_type = 'signup') AS yellow, count(*) FILTER (event_type = 'error') AS red, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS added_24h,
count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND event_type = 'error') AS failed_24h, round((count(*) FILTER (event_type = 'error'))::DOUBLE / nullif(count(*), 0), 4) AS failure_rate FROM events""")
def daily_report(t):
    day = F.col("ts") >= as_of() - F.expr("INTERVAL 1 DAY")
    bad = F.col("event_type") == "error"
    return t.events.agg(F.count_if(F.col("event_type").isin("view", "click")).alias("green"), F.count_if(F.col("event_type") == "signup").alias("yellow"), F.count_if(bad).alias("red"), F.count_if(day).alias("added_24h"), F.count_if(day & bad).alias("failed_24h"), F.round(F.count_if(bad) / F.nullif(F.count("*"), F.lit(0)), 4).alias("failure_rate"))


PAIRS = "i AS (SELECT event_id AS id, event_type AS lang, epoch_us(ts) // 1000000 AS at FROM events), p AS (SELECT x.id, y.id AS other FROM i x JOIN i y ON x.lang = y.lang AND x.id <> y.id AND abs(x.at - y.at) <= 172800)"


def vectors_of(t, items):
    """Items with ``vector``: the embeddings dealt over them by ``id``, all used."""
    n = t.embeddings.agg(F.count("*").alias("n"))  # one row
    return items.crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("id") % F.col("n")).drop("n").join(t.embeddings.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def dated_vectors(t):
    return vectors_of(t, t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("lang"), F.col("ts").cast("timestamp").alias("ts")))


SCORES = "s AS (SELECT id, other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM p, (SELECT count(*) AS n FROM embeddings) JOIN embeddings a ON a.vec_id = id % n JOIN embeddings b ON b.vec_id = other % n)"


@query(f"""WITH {PAIRS}, {SCORES} SELECT id, other, round(score, 5) AS score FROM s WHERE score >= 0.2""")
def event_cluster_pairs(t):
    """All pairs of a type within 48 hours, so the result grows with the square of a window's events."""
    return C.window_pairs(dated_vectors(t), 0.2, Scratch(t.spark)).select("id", "other", F.round("score", 5).alias("score"))


#: Checks ``event_cluster_labels`` on small tables: the walk takes the square of a cluster's size.
LABELS = f"""WITH RECURSIVE {PAIRS}, {SCORES}, e AS (SELECT id AS u, other AS v FROM s WHERE score >= 0.5),
b2 AS (SELECT u, v FROM e UNION SELECT v, u FROM e), w AS (SELECT event_id AS id, event_id AS got FROM events UNION SELECT w.id, b2.v FROM w JOIN b2 ON w.got = b2.u) SELECT id, min(got) AS cluster FROM w GROUP BY id"""


@query()
def event_cluster_labels(t):
    scratch = Scratch(t.spark)
    edges = C.window_links(dated_vectors(t), 0.5, scratch).select(F.col("id").alias("u"), F.col("other").alias("v"))
    return E.cluster_labels(edges, t.events.select(F.col("event_id").alias("id")), scratch)


ARRIVALS = """i AS MATERIALIZED (SELECT event_id AS id, event_type AS lang, epoch_us(ts) // 1000000 AS at, CASE WHEN event_id % 25 = 0 THEN 's' || (user_id % 7) ELSE '' END AS story, CASE WHEN event_id % 10 = 0 THEN ['u' || (user_id % 300)] ELSE [] END AS related, 'u' || (event_id * 7 % 300) AS url,
row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000, event_id) AS place, embedding::DOUBLE[] AS v FROM events, (SELECT count(*) AS n FROM embeddings) JOIN embeddings ON vec_id = event_id % n),
c AS (SELECT x.id, y.id AS up, y.place, x.story <> '' AND x.story = y.story AS hard, round(list_cosine_similarity(x.v, y.v) + CASE WHEN list_has_any(x.related, y.related) OR list_has_any(x.related || y.related, [x.url, y.url]) THEN 0.2 ELSE 0 END, 9) AS score
FROM i x JOIN i y ON x.lang = y.lang AND y.place BETWEEN x.place - 100 AND x.place - 1 AND y.at >= x.at - 172800),
u AS (SELECT id, up FROM c WHERE hard OR score >= 0.75 QUALIFY row_number() OVER (PARTITION BY id ORDER BY hard DESC, CASE WHEN hard THEN 0 ELSE score END DESC, place DESC) = 1)"""


@query(f"WITH RECURSIVE {ARRIVALS}, w AS (SELECT event_id AS id, event_id AS got FROM events UNION ALL SELECT w.id, u.up FROM w JOIN u ON w.got = u.id) SELECT id, min(got) AS cluster FROM w GROUP BY id")
def event_clusters_online(t):
    key = F.col("event_id")
    text = lambda c: F.concat(F.lit("u"), c.cast("string"))
    rows = t.events.select(
        key.alias("id"), F.col("event_type").alias("lang"), F.col("ts").cast("timestamp").alias("ts"), F.when(key % 25 == 0, F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string"))).otherwise("").alias("story"),
        F.when(key % 10 == 0, F.array(text(F.col("user_id") % 300))).otherwise(F.array().cast("array<string>")).alias("related"), text(key * 7 % 300).alias("url"))
    return C.arrival_clusters(vectors_of(t, rows))


@query("SELECT c_custkey AS id, CASE WHEN contradiction THEN 5 WHEN rel IN ('A', 'B') AND n >= 2 THEN 1 WHEN rel IN ('A', 'B') THEN 2 WHEN rel = 'C' THEN 3 WHEN rel IN ('D', 'E') THEN 4 ELSE 6 END AS grade, rel IN ('D', 'E') AND n <= 1 AS uncertain FROM (SELECT c_custkey, substr('ABCDEF', c_nationkey % 6 + 1, 1) AS rel, c_custkey % 4 AS n, c_custkey % 11 = 0 AS contradiction FROM customer)")
def content_grades(t):
    rows = t.customer.select("c_custkey", F.expr("substr('ABCDEF', c_nationkey % 6 + 1, 1)").alias("rel"), (F.col("c_custkey") % 4).alias("n"), (F.col("c_custkey") % 11 == 0).alias("contradiction"))
    return rows.select(F.col("c_custkey").alias("id"), S.grade(F.col("rel"), F.col("n"), F.col("contradiction")).alias("grade"), S.is_uncertain(F.col("rel"), F.col("n")).alias("uncertain"))


@query("""SELECT c_custkey AS id, CASE WHEN b < 1000 THEN 'none' WHEN b < 5000 THEN 'warn' WHEN b < 10000 THEN CASE WHEN p = 'control' THEN 'skip' ELSE 'warn' END ELSE CASE WHEN p = 'continuous' OR trust >= 0.85 THEN 'warn' ELSE 'skip' END END AS decision
FROM (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'continuous' WHEN 1 THEN 'periodic' ELSE 'control' END AS p, (c_custkey % 10) / 10.0 AS trust, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS b FROM customer)""")
def backpressure_decisions(t):
    backlog = t.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    p = F.when(F.col("c_nationkey") % 3 == 0, "continuous").when(F.col("c_nationkey") % 3 == 1, "periodic").otherwise("control")
    return t.customer.crossJoin(F.broadcast(backlog)).select(F.col("c_custkey").alias("id"), S.backpressure(F.col("b"), p, (F.col("c_custkey") % 10) / 10.0).alias("decision"))


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN TRUE ELSE c_custkey % 5 > 0 AND epoch(TIMESTAMP '{AS_OF}') - (c_custkey % 7) * 600 + greatest(60, 1800 + ((CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE) * 2 - 1) * 0.1::DOUBLE * 1800) <= epoch(TIMESTAMP '{AS_OF}') END AS due FROM customer""")
def crawl_due(t):
    now = F.unix_seconds(F.lit(AS_OF).cast("timestamp"))
    last = now - (F.col("c_custkey") % 7) * 600
    return t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 13 == 0, True).otherwise((F.col("c_custkey") % 5 > 0) & (last + F.greatest(F.lit(60.0), 1800 + S.jitter(F.col("c_custkey"), F.lit(1800), 0.1)) <= now)).alias("due"))
