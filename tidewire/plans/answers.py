"""Queries around answers and whole search paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators import answers as W
from tidewire.operators import pipelines as P
from tidewire.plans.registry import query
from tidewire.plans.retrieval import LISTS

LABEL = "CASE l_linenumber % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'TOP' END"


def answers_of(rows, quantity):
    n = F.col("l_linenumber") % 4
    label = F.when(n == 0, "LOW").when(n == 1, "MEDIUM").when(n == 2, "HIGH").otherwise("TOP")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("answer_id"), (F.col("l_returnflag") != "R").alias("cited"), (F.col("l_tax") > 0.06).alias("unsupported"), (quantity / 50).alias("groundedness"), label.alias("label"), F.when(F.col("l_orderkey") % 17 == 0, "Ответ  не транслирует мнение своих разработчиков.").otherwise("Text").alias("answer"))


@query("SELECT l_orderkey * 10 + l_linenumber AS answer_id, l_returnflag = 'R' OR l_tax > 0.06 OR l_quantity / 50 < 0.45 AS needs_correction, l_orderkey % 17 = 0 AS refused FROM lineitem")
def answer_checks(t):
    return W.checked(answers_of(t.lineitem, F.col("l_quantity"))).select("answer_id", "needs_correction", "refused")


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS answer_id, bool_or(l_returnflag <> 'R')::INT AS c, (NOT bool_and(l_tax > 0.06))::INT AS s, max(CAST(floor(l_quantity / 25) AS INT)) AS g, max(l_linenumber % 4) AS w FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey * 10 + l_linenumber AS answer_id, bool_or(l_partkey % 3 > 0)::INT AS c, (NOT bool_and(l_suppkey % 4 = 0))::INT AS s, max(CAST(floor((l_partkey % 51) / 25) AS INT)) AS g, max(l_suppkey % 4) AS w FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1)
SELECT a.answer_id, coalesce(r.c > a.c OR r.c = a.c AND (r.s > a.s OR r.s = a.s AND (r.g > a.g OR r.g = a.g AND r.w > a.w)), FALSE) AS corrected FROM a LEFT JOIN r ON a.answer_id = r.answer_id""")
def answers_improved(t):
    """All four keys differ between the two answers; an id stands more than once in the table, and what its rows say best counts."""

    def rows(of, cited, unsupported, grounded, level):
        label = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "TOP"))), F.max(level).cast("int") + 1)
        return of.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("answer_id")).agg(F.max(cited).alias("cited"), F.min(unsupported).alias("unsupported"), F.max(F.floor(grounded / 25)).cast("double").alias("groundedness"), label.alias("label"))

    c = F.col
    first = rows(t.lineitem, c("l_returnflag") != "R", c("l_tax") > 0.06, c("l_quantity"), c("l_linenumber") % 4)
    return W.better(first, rows(t.lineitem.where("l_suppkey % 3 > 0"), c("l_partkey") % 3 > 0, c("l_suppkey") % 4 == 0, c("l_partkey") % 51, c("l_suppkey") % 4))


@query("""WITH u AS (SELECT l_orderkey AS answer_id, l_linenumber AS i, l_suppkey AS news_id FROM lineitem), f AS (SELECT answer_id, news_id, min(i) AS i FROM u GROUP BY ALL) SELECT answer_id, news_id, s_name AS source, row_number() OVER (PARTITION BY answer_id ORDER BY i, news_id) AS place FROM f JOIN supplier ON s_suppkey = news_id""")
def answer_sources(t):
    used = t.lineitem.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("index"), F.col("l_suppkey").alias("news_id"))
    return W.sources_used(used, t.supplier.select(F.col("s_suppkey").alias("news_id"), F.col("s_name").alias("source")))


@query("""WITH a AS (SELECT l_orderkey AS q, round(avg(l_quantity) / 50, 6) AS q1, round(max(l_discount) * 9, 6) AS q2, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT q AS query_id, CASE WHEN q1 < 0.62 THEN 'news ' || q END AS refined, q1 < 0.62 AS should_retry, q1 < 0.62 AND q2 > q1 AS used_retry,
CASE WHEN q1 >= 0.62 THEN 'initial_context_good_enough' WHEN q2 > q1 THEN 'retry_improved_context' ELSE 'retry_did_not_improve_context' END AS reason FROM a""")
def corrective_retrieval(t):
    made = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.round(F.avg("l_quantity") / 50, 6).alias("q1"), F.round(F.max("l_discount") * 9, 6).alias("q2"), F.count("*").alias("documents"))
    asked = made.select("query_id", F.concat(F.lit("расскажи про news "), F.col("query_id").cast("string")).alias("query"))
    return W.corrective(made.select("query_id", F.col("q1").alias("quality")), made.select("query_id", F.col("q2").alias("quality"), "documents"), asked)


@query("""WITH q AS (SELECT conv_id AS query_id, CASE WHEN conv_id % 9 = 0 THEN 'спасибо' ELSE substr(text, 1, 40) END AS query FROM conversations WHERE turn = 0), d AS (SELECT conv_id AS query_id, turn AS news_id, text FROM conversations WHERE turn > 0),
t AS (SELECT query_id, query, list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS terms FROM q), n AS (SELECT d.query_id, count(*) AS relevant FROM d JOIN t ON d.query_id = t.query_id WHERE len(terms) = 0 OR list_has_any(terms, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) GROUP BY ALL)
SELECT t.query_id, coalesce(relevant, 0) AS relevant, coalesce(relevant, 0) = 0 AND query <> 'спасибо' AS retrieve, CASE WHEN coalesce(relevant, 0) = 0 AND query <> 'спасибо' THEN 'retrieval_triggered_for_missing_relevant_context' WHEN query = 'спасибо' THEN 'no_retrieve_smalltalk_like_query' ELSE 'existing_context_relevant' END AS reason FROM t LEFT JOIN n ON t.query_id = n.query_id""")
def self_checked_retrieval(t):
    c = t.conversations
    asked = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.when(F.col("conv_id") % 9 == 0, "спасибо").otherwise(F.substring("text", 1, 40)).alias("query"))
    return W.self_checked(asked, c.where("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("news_id"), "text"))


@query("""WITH d AS (SELECT conv_id, list({'i': turn, 't': text} ORDER BY turn) AS ds FROM conversations WHERE turn > 0 GROUP BY conv_id) SELECT c.conv_id, md5('SYSTEM:' || chr(10) || 'Answer from the documents.' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) ||
array_to_string(list_transform(ds, lambda x: '[Doc ' || x.i || '] chat | turn' || chr(10) || x.t), chr(10) || chr(10)) || chr(10) || chr(10) || 'USER:' || chr(10) || c.text) AS prompt FROM conversations c JOIN d ON c.conv_id = d.conv_id WHERE c.turn = 0 AND c.text <> ''""")
def answer_prompts(t):
    c = t.conversations
    docs = c.where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("index"), F.lit("chat").alias("source"), F.lit("turn").alias("title"), F.col("text").alias("content")))).alias("docs"))
    rows = c.where("turn = 0 AND text <> ''").select("conv_id", "text").join(docs, "conv_id")
    return rows.select("conv_id", F.md5(T.prompt(F.lit("Answer from the documents."), F.col("docs"), F.col("text")).cast("binary")).alias("prompt"))


SEARCHED = f"""{LISTS}, g AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS fs FROM l GROUP BY ALL), n1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fs, 12) DESC, id) AS fr FROM g), n2 AS (SELECT query_id, id, fs / max(fs) OVER (PARTITION BY query_id) AS norm FROM n1 WHERE fr <= 20),
qq AS (SELECT item_id AS query_id, text AS query, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3)) AS terms FROM benchmark),
h AS (SELECT n2.*, query, terms, lower(substr(d.text, 1, 80)) AS title, lower(substr(d.text, 1, 280)) AS lead, lower(source) AS meta, lower(substr(d.text, 1, 4000)) AS body, lower(d.text) AS whole, d.doc_id % 10 / 10.0::DOUBLE AS trust, d.doc_id % 6 + 1 AS grade, d.doc_id % 8 / 8.0::DOUBLE AS fresh, CASE WHEN d.doc_id % 3 = 0 THEN 'title' ELSE 'body' END AS zone,
CASE WHEN d.doc_id % 5 > 0 THEN d.doc_id % 9 / 9.0::DOUBLE END AS value, d.text AS raw FROM n2 JOIN qq ON n2.query_id = qq.query_id JOIN documents d ON d.doc_id = n2.id),
mm AS (SELECT *, least(1.0::DOUBLE, 0.42::DOUBLE * (len(list_filter(terms, lambda t: contains(title, t)))::DOUBLE / len(terms)) + 0.24::DOUBLE * (len(list_filter(terms, lambda t: contains(lead, t)))::DOUBLE / len(terms)) + 0.22::DOUBLE * (len(list_filter(terms, lambda t: contains(meta, t)))::DOUBLE / len(terms)) + 0.12::DOUBLE * (len(list_filter(terms, lambda t: contains(body, t)))::DOUBLE / len(terms))
+ CASE WHEN length(query) >= 8 AND contains(title || ' ' || lead, lower(query)) THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN len(list_filter(terms, lambda t: regexp_full_match(t, '[0-9]+') AND (contains(title || ' ' || lead, t) OR contains(raw, t)))) > 0 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END) AS match FROM h),
s1 AS (SELECT *, 0.50::DOUBLE * (0.80::DOUBLE * norm + 0.20::DOUBLE * 0.5) + 0.20::DOUBLE * trust + 0.15::DOUBLE * (1.0 - (grade - 1) / 5.0::DOUBLE) + 0.15::DOUBLE * fresh AS raw1 FROM mm),
s3 AS (SELECT *, least(1.0::DOUBLE, CASE WHEN value IS NULL THEN raw1 ELSE 0.80::DOUBLE * raw1 + 0.20::DOUBLE * value END * CASE WHEN match < 0.05 OR zone <> 'title' THEN 1.0::DOUBLE ELSE 1.2::DOUBLE END) AS sc FROM s1),
s4 AS (SELECT query_id, id AS news_id, norm, round(least(1.0::DOUBLE, (0.86::DOUBLE * sc + 0.14::DOUBLE * match) * CASE WHEN match < 0.20 THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END), 4) AS score FROM s3), s5 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, news_id) AS rank FROM s4)"""


@query(f"WITH {SEARCHED} SELECT query_id, news_id, score, round(norm, 6) AS retrieval, rank FROM s5 WHERE rank <= 10")
def search_pipeline(t):
    i = F.col("doc_id")
    rows = t.documents.select("doc_id", "text", F.substring("text", 1, 80).alias("title"), F.substring("text", 1, 280).alias("lead"), "source", F.when(i % 3 == 0, "title").otherwise("body").alias("zone"), (i % 10 / 10.0).alias("trust"), (i % 6 + 1).alias("grade"), (i % 8 / 8.0).alias("freshness"), F.when(i % 5 > 0, i % 9 / 9.0).alias("value"))
    return P.search(rows, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 10, 20).select("query_id", "news_id", "score", "retrieval", "rank")


PROFILE = """r AS (SELECT user_id, event_id AS news_id, event_id % 7 AS source_id, event_type AS topic, round(value / 100, 4) AS base, event_id % 6 + 1 AS grade, event_id % 17 = 0 AS unsure FROM events),
w AS (SELECT user_id, event_type AS topic, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id), 4) AS weight FROM events GROUP BY user_id, event_type), s AS (SELECT DISTINCT user_id, event_id % 7 AS source_id, CASE (user_id + event_id % 7) % 5 WHEN 0 THEN 'preferred' WHEN 1 THEN 'blocked' ELSE 'neutral' END AS preference, ((user_id + event_id % 7) % 11) / 10.0::DOUBLE AS implicit FROM events),
n AS (SELECT user_id, event_id AS news_id FROM events WHERE event_id % 4 = 0), c AS (SELECT DISTINCT user_id, event_type AS topic FROM events WHERE event_id % 10 = 3),
j AS (SELECT r.*, greatest(0, coalesce(weight, 0.5) - 0.5) AS ta, preference, CASE WHEN preference = 'preferred' THEN 1.0::DOUBLE WHEN preference = 'blocked' THEN -1.0::DOUBLE WHEN abs(least(greatest(implicit - 0.5, -0.5), 0.5)) >= 0.2 THEN least(greatest(implicit - 0.5, -0.5), 0.5) ELSE 0.0::DOUBLE END AS sa, n.news_id IS NOT NULL AS seen, c.topic IS NOT NULL AS now
FROM r LEFT JOIN w ON r.user_id = w.user_id AND r.topic = w.topic LEFT JOIN s ON r.user_id = s.user_id AND r.source_id = s.source_id LEFT JOIN n ON r.user_id = n.user_id AND r.news_id = n.news_id LEFT JOIN c ON r.user_id = c.user_id AND r.topic = c.topic),
k AS (SELECT *, round(least(greatest(base + least(0.18::DOUBLE * ta + 0.10::DOUBLE * greatest(sa, 0) + 0.15::DOUBLE * now::INT, CASE WHEN unsure OR grade >= 5 THEN 0.03::DOUBLE WHEN grade = 4 THEN 0.06::DOUBLE ELSE 0.12::DOUBLE END) - 0.10::DOUBLE * abs(least(sa, 0)) - 0.30::DOUBLE * seen::INT - (preference = 'blocked')::INT, 0), 1), 4) AS score FROM j)"""


def profile_of(t):
    e, i = t.events, F.col("event_id")
    results = e.select("user_id", i.alias("news_id"), (i % 7).alias("source_id"), F.col("event_type").alias("topic"), F.round(F.col("value") / 100, 4).alias("base"), (i % 6 + 1).alias("grade"), (i % 17 == 0).alias("uncertain"))
    per = e.groupBy("user_id", F.col("event_type").alias("topic")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    topics = per.select("user_id", "topic", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 4).alias("weight"))
    k = F.col("user_id") + F.col("source_id")
    sources = e.select("user_id", (i % 7).alias("source_id")).distinct().select("user_id", "source_id", F.when(k % 5 == 0, "preferred").when(k % 5 == 1, "blocked").otherwise("neutral").alias("preference"), (k % 11 / 10.0).alias("implicit"))
    return results, {"topics": topics, "sources": sources, "seen": e.where(i % 4 == 0).select("user_id", i.alias("news_id")), "recent": e.where(i % 10 == 3).select("user_id", F.col("event_type").alias("topic"))}


@query(f"""WITH {PROFILE} SELECT user_id, news_id, base, score, array_to_string(list_filter([CASE WHEN ta > 0 THEN 'topic' END, CASE WHEN preference = 'blocked' THEN 'source_blocked' WHEN sa > 0 THEN 'source_preferred' WHEN sa < 0 THEN 'source_disliked' END, CASE WHEN now THEN 'session' END, CASE WHEN seen THEN 'seen_penalty_applied' END,
CASE WHEN grade >= 5 THEN 'trust_guard: grade=' || grade WHEN unsure THEN 'trust_guard: uncertain' END], lambda x: x IS NOT NULL), ',') AS reasons, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, news_id) AS rank FROM k""")
def personal_pipeline(t):
    results, profile = profile_of(t)
    return P.for_user(results, **profile).select("user_id", "news_id", "base", "score", "reasons", "rank")


@query()
def personal_feed(t):
    """Ranked and spread over sources and topics, for every user (the spread is a fold: no SQL)."""
    results, profile = profile_of(t)
    return P.personal(results, 0.5, **profile)


@query("SELECT conv_id, turn, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) / 2.5::DOUBLE, 4) AS seconds FROM conversations")
def speech_seconds(t):
    return t.conversations.select("conv_id", "turn", F.round(T.speech_seconds(F.col("text")), 4).alias("seconds"))


@query("SELECT o_orderkey AS id, round(greatest(0, (epoch_us(o_orderdate + INTERVAL (o_orderkey % 9 - 4) HOUR) - epoch_us(o_orderdate)) / 1e6), 3)::DOUBLE AS seconds FROM orders")
def run_durations(t):
    start = F.col("o_orderdate").cast("timestamp")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.round(S.duration(start, start + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 9 - 4).cast("int"))), 3).alias("seconds"))
