"""Personal queries: events as interactions, embeddings as article vectors, documents as ranked results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.operators import events as E
from tidewire.operators import matching as M
from tidewire.operators import personal as P
from tidewire.operators.retrieval import ranked
from tidewire.plans.registry import query

ACTION = "CASE event_type WHEN 'signup' THEN 'like' WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'dislike' WHEN 'view' THEN 'read' ELSE 'click' END"
SIGNAL = "CASE a WHEN 'like' THEN 1.0 WHEN 'save' THEN 0.8 WHEN 'dislike' THEN -1.0 WHEN 'read' THEN CASE WHEN value >= 45 THEN 0.7 ELSE 0.5 END ELSE CASE WHEN value >= 45 THEN 0.7 ELSE 0.3 END END"


def interactions(t):
    c = F.col("event_type")
    action = F.when(c == "signup", "like").when(c == "purchase", "save").when(c == "error", "dislike").when(c == "view", "read").otherwise("click")
    return t.events.select("user_id", (F.col("event_id") % 20).alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 500).alias("news_id"), S.signal(action, F.col("value")).alias("signal"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id % 20 AS key, ts, event_id, {ACTION} AS a, value FROM events), s AS (SELECT user_id, key, ({SIGNAL})::DOUBLE AS signal, row_number() OVER (PARTITION BY user_id, key ORDER BY ts, event_id) AS i FROM e),
w AS (SELECT DISTINCT user_id, key, 0::BIGINT AS i, 0.5::DOUBLE AS weight FROM s UNION ALL SELECT w.user_id, w.key, s.i, floor(least(greatest(0.75::DOUBLE * w.weight + 0.25::DOUBLE * least(greatest((s.signal + 1) / 2, 0), 1), 0), 1) * 10000 + 0.5) / 10000 FROM w JOIN s ON w.user_id = s.user_id AND w.key = s.key AND s.i = w.i + 1)
SELECT user_id, key, arg_max(weight, i) AS weight FROM w GROUP BY ALL""")
def user_profile_ewma(t):
    return P.ewma_weights(interactions(t))


@query(f"""WITH e AS (SELECT user_id, event_id % 500 AS news_id, ts, event_id AS seq, {ACTION} AS a, value FROM events), s AS (SELECT *, ({SIGNAL})::DOUBLE AS weight, row_number() OVER (PARTITION BY user_id, news_id ORDER BY ts DESC, seq DESC) AS r FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS rr FROM s WHERE r = 1 AND weight > 0), v AS (SELECT user_id, weight, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM k JOIN embeddings ON vec_id = news_id WHERE rr <= 50)
SELECT user_id, pos - 1 AS pos, round(sum(weight * x) / sum(weight), 5) AS mean FROM v GROUP BY ALL""")
def user_centroid(t):
    actions = interactions(t).withColumnRenamed("signal", "weight")
    made = P.centroids(actions, t.embeddings.select(F.col("vec_id").alias("news_id"), F.col("embedding").alias("vector")))
    return made.select("user_id", F.posexplode("vector").alias("pos", "x")).select("user_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("mean"))


@query("WITH l AS (SELECT user_id, event_id % 500 AS news_id, max(event_id) AS seq FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rank FROM l) SELECT * FROM r WHERE rank <= 20")
def session_mru(t):
    return P.recent_unique(interactions(t).select("user_id", "news_id", "seq"))


@query("WITH x AS (SELECT user_id, event_id % 50 AS news_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events), l AS (SELECT user_id, news_id, max(seq) AS seq FROM x WHERE b <= 40 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rank FROM l) SELECT * FROM r WHERE rank <= 1000")
def seen_history(t):
    rows = interactions(t).select("user_id", (F.col("seq") % 50).alias("news_id"), "seq")
    return P.recent_unique(rows, 1000, 40)


@query("""WITH x AS (SELECT event_id AS id, value / 100 AS base, (event_id % 10) / 20.0 AS topic, (event_id % 7) / 14.0 AS entity, CASE event_id % 5 WHEN 0 THEN 'preferred' WHEN 1 THEN 'blocked' ELSE 'neutral' END AS pref, (event_id % 11) / 10.0 AS implicit, (event_id % 3 = 0)::INT AS session, (event_id % 13) / 13.0 AS emb, event_id % 4 = 0 AS seen, event_id % 6 + 1 AS grade, event_id % 17 = 0 AS unsure FROM events),
y AS (SELECT *, CASE WHEN pref = 'preferred' THEN 1.0 WHEN pref = 'blocked' THEN -1.0 WHEN abs(least(greatest(implicit - 0.5, -0.5), 0.5)) >= 0.2 THEN least(greatest(implicit - 0.5, -0.5), 0.5) ELSE 0.0 END AS source FROM x)
SELECT id, round(least(greatest(base + least(0.18 * topic + 0.20 * entity + 0.10 * greatest(source, 0) + 0.15 * session + 0.08 * emb, CASE WHEN unsure OR grade >= 5 THEN 0.03 WHEN grade = 4 THEN 0.06 ELSE 0.12 END) - 0.10 * abs(least(source, 0)) - 0.30 * seen::INT - (pref = 'blocked')::INT, 0), 1), 4) AS score FROM y""")
def personal_rerank(t):
    i = F.col("event_id")
    pref = F.when(i % 5 == 0, "preferred").when(i % 5 == 1, "blocked").otherwise("neutral")
    score = S.personal_score(F.col("value") / 100, (i % 10) / 20.0, (i % 7) / 14.0, S.source_affinity(pref, (i % 11) / 10.0), (i % 3 == 0).cast("int"), (i % 13) / 13.0, i % 4 == 0, i % 6 + 1, i % 17 == 0, pref == "blocked")
    return t.events.select(i.alias("id"), F.round(score, 4).alias("score"))


def results(t, most=40):
    """Documents ranked by length within their language, as results of one query each."""
    rows = t.documents.select(F.col("lang").alias("key"), F.col("doc_id").alias("news_id"), F.substring("source", 4, 9).cast("long").alias("source_id"), F.array(F.concat(F.lit("t"), (F.col("doc_id") % 6).cast("string"))).alias("topics"), "n_chars")
    return ranked(rows, ["key"], [F.desc("n_chars"), F.col("news_id")], most).withColumn("score", 1.0 - F.col("rank") / 1000.0)


@query()
def diversity_caps(t):
    return P.diversified(results(t), 0.5)


@query()
def digest_shortlist(t):
    sent = results(t).where("rank % 4 = 1").select("key", "news_id")
    return P.digest(results(t), 12, sent)


@query()
def digest_hash(t):
    return P.digest_hashes(P.digest(results(t), 12), "daily")


@query("""WITH n AS (SELECT event_id AS news_id, user_id AS entity, event_type AS topic, value, props FROM events WHERE ts >= TIMESTAMP '2024-01-30'), u AS (SELECT c_custkey AS user_id, c_custkey % 150 AS entity, c_mktsegment, 'k": ' || (c_custkey % 100) || '}' AS keyword FROM customer),
sp AS (SELECT entity FROM (SELECT user_id AS entity, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31') AS cur, count(*) FILTER (ts < TIMESTAMP '2024-01-30') / 30.0 AS base FROM events GROUP BY ALL) WHERE cur >= 3 AND cur > 2 * base),
a AS (SELECT user_id, 'alert_news' AS alert_type, news_id, n.entity AS entity_id, NULL::VARCHAR AS topic_id, 0.9 AS score FROM n JOIN u ON n.entity = u.entity), d AS (SELECT user_id, 'keyword_match' AS alert_type, news_id, NULL::BIGINT AS entity_id, keyword AS topic_id, 0.82 AS score FROM n JOIN u ON contains(props, keyword)),
p AS (SELECT user_id, 'spike' AS alert_type, news_id, n.entity AS entity_id, NULL::VARCHAR AS topic_id, 0.85 AS score FROM n JOIN u ON n.entity = u.entity WHERE n.entity IN (SELECT entity FROM sp)),
b AS (SELECT user_id, 'breaking' AS alert_type, news_id, NULL::BIGINT AS entity_id, NULL::VARCHAR AS topic_id, 0.95 AS score FROM n JOIN u ON c_mktsegment = 'MACHINERY' AND topic = 'error' AND value > 90 AND news_id % 2 = 1),
c AS (SELECT user_id, 'tracked_topic' AS alert_type, news_id, NULL::BIGINT AS entity_id, topic AS topic_id, 0.8 AS score FROM n JOIN u ON c_mktsegment = 'BUILDING' AND topic = 'purchase'), x AS (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c UNION SELECT * FROM d UNION SELECT * FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, alert_type, news_id, entity_id NULLS FIRST, topic_id NULLS FIRST) AS rank FROM x) SELECT user_id, alert_type, news_id, entity_id, topic_id, score::DOUBLE AS score, rank FROM r WHERE rank <= 50""")
def alert_candidates(t):
    """All five kinds for all customers. A list (an entity's news, a keyword's, a segment's) has one score, so nobody is shown more than its first 50: only these are dealt out, to whoever follows it."""
    n = t.events.where("ts >= '2024-01-30'").select(F.col("event_id").alias("news_id"), F.col("user_id").alias("entity"), F.col("event_type").alias("topic"), "value", "props")
    u = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 150).alias("entity"), "c_mktsegment", F.concat(F.lit('k": '), (F.col("c_custkey") % 100).cast("string"), F.lit("}")).alias("word"))
    none, no_id, s = F.lit(None).cast("string"), F.lit(None).cast("long"), P.ALERT_SCORES
    list_ = lambda rows, k, key, e, p: rows.select(F.lit(k).alias("alert_type"), key.cast("string").alias("key"), "news_id", e.alias("entity_id"), p.alias("topic_id"), F.lit(s[k]).alias("score"))
    day = F.lit("2024-01-31").cast("timestamp_ntz")
    spikes = E.entity_profiles(t.events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("source"), F.lit(1).alias("n"), "ts"), day).where("current >= 3 AND current > 2 * baseline").select("entity")
    entity = F.col("entity")
    found = M.contained(n.select(F.col("news_id").alias("id"), F.col("props").alias("text")), u.select(F.col("word").alias("pattern"))).withColumnRenamed("id", "news_id")
    lists = [
        list_(n, "alert_news", entity, entity, none), list_(n.join(spikes, "entity", "left_semi"), "spike", entity, entity, none), list_(found, "keyword_match", F.col("pattern"), no_id, F.col("pattern")),
        list_(n.where("topic = 'error' AND value > 90 AND news_id % 2 = 1"), "breaking", F.lit("MACHINERY"), no_id, none), list_(n.where("topic = 'purchase'"), "tracked_topic", F.lit("BUILDING"), no_id, F.col("topic")),
    ]
    own = lambda k, key: F.struct(F.lit(k).alias("alert_type"), key.cast("string").alias("key"))
    follows = u.select("user_id", F.inline(F.array(own("alert_news", entity), own("spike", entity), own("keyword_match", F.col("word")), own("breaking", F.col("c_mktsegment")), own("tracked_topic", F.col("c_mktsegment")))))
    return P.dealt_alerts(lists, follows)


@query("""WITH m AS (SELECT max(ts) AS e FROM events), a AS (SELECT user_id FROM events, m GROUP BY user_id, e HAVING max(ts) > e - INTERVAL 24 HOUR), w AS (SELECT user_id, event_id % 97 AS news_id, event_id AS seq FROM events WHERE user_id IN (SELECT user_id FROM a) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30),
l AS (SELECT user_id, news_id, max(seq) AS seq FROM w GROUP BY ALL) SELECT user_id, news_id, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rank FROM l QUALIFY rank <= 10""")
def seen_within_a_day(t):
    rows = t.events.select("user_id", (F.col("event_id") % 97).alias("news_id"), F.col("event_id").alias("seq"), "ts")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("e"))))  # one row
    return P.recent_unique(rows, 10, 30, F.col("e")).select("user_id", "news_id", "rank")
