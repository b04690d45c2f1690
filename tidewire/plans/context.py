"""Context queries: documents as retrieved articles, conversations as chats and answers, pages as web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators import context as X
from tidewire.operators.retrieval import ranked
from tidewire.plans.registry import query


def docs_of(t):
    return t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("news_id"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 90).alias("cluster"), (F.col("doc_id") % 37).alias("score"), (F.col("doc_id") % 10 / 10.0).alias("trust"), F.col("text").alias("content"))


@query("""WITH d AS (SELECT lang AS query_id, doc_id AS news_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 90 AS VARCHAR) ELSE '#' || doc_id END AS g, doc_id % 37 AS score, doc_id % 10 / 10.0 AS trust FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, trust DESC, news_id) AS place FROM d) SELECT query_id, news_id, place, CASE WHEN place = 1 THEN 'representative' ELSE 'supporting' END AS role FROM r WHERE place <= 3""")
def cluster_representatives(t):
    return X.cluster_representatives(docs_of(t), [F.desc("score"), F.desc("trust"), F.col("news_id")]).select("query_id", "news_id", "place", "role")


@query("""WITH d AS (SELECT source AS query_id, doc_id AS news_id, text AS content, row_number() OVER (PARTITION BY source ORDER BY doc_id % 37 DESC, doc_id) AS rank FROM documents), o AS (SELECT *, greatest(1, length(content) // 2) + 10 AS own FROM d WHERE rank <= 30),
u AS (SELECT *, sum(own) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM o), v AS (SELECT *, sum(CASE WHEN upto > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS over FROM u), w AS (SELECT *, 6000 - (upto - own) - 10 AS room FROM v)
SELECT query_id, news_id, rank, over = 1 AS trimmed, length(CASE WHEN over = 1 THEN rtrim(substr(content, 1, CAST(greatest(1, room * 2 - 3) AS BIGINT))) || '...' ELSE content END) AS size FROM w WHERE over = 0 OR (over = 1 AND room > 0)""")
def context_budget(t):
    rows = t.documents.select(F.col("source").alias("query_id"), F.col("doc_id").alias("news_id"), F.col("text").alias("content"))
    rows = ranked(rows, ["query_id"], [F.desc(F.col("news_id") % 37), F.col("news_id")], 30)
    made = X.within_budget(rows, 6000, F.lit(10))
    return made.select("query_id", "news_id", "rank", "trimmed", F.char_length("content").cast("long").alias("size"))


@query()
def sentence_chunks(t):
    return X.sentence_chunks(t.documents)


MESSAGES = "m AS (SELECT conv_id AS session, turn AS seq, role, text, count(*) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)"


def messages(t):
    return t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text")


@query(f"WITH {MESSAGES} SELECT session, seq, role, total, row_number() OVER (PARTITION BY session ORDER BY seq) AS position FROM m WHERE back <= 4")
def chat_window(t):
    return X.chat_window(messages(t), 2).select("session", "seq", "role", "total", "position")


@query(f"""WITH {MESSAGES} SELECT session, '[' || string_agg('{{"role":"' || role || '","content":' || CAST(to_json(substr(text, 1, 200)) AS VARCHAR) || '}}', ',' ORDER BY seq) || ']' AS summary FROM m WHERE back <= 6 AND total >= 6 GROUP BY session""")
def summary_tail(t):
    return X.summary_tail(messages(t), 6)


@query("SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS sessions, round(avg(length(text)), 4) AS mean_length FROM conversations GROUP BY role")
def chat_counts(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("sessions"), F.round(F.avg(F.char_length("text")), 4).alias("mean_length"))


STEM = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4), lambda w: regexp_replace(w, '(ings?|ed|es|s|ов|ами|ями|ах|ях|ы|и|а|я|е|у|ю)$', '')))"


@query(f"""WITH c AS (SELECT conv_id AS answer_id, turn AS claim_id, {STEM.format(c='text')} AS tokens FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id AS answer_id, {STEM.format(c='text')} AS seen FROM conversations WHERE role <> 'assistant'),
b AS (SELECT c.answer_id, claim_id, max(coalesce(len(list_intersect(tokens, seen))::DOUBLE / nullif(len(tokens), 0), 0)) AS share FROM c LEFT JOIN s ON c.answer_id = s.answer_id GROUP BY ALL),
g AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (share >= 0.1) AS supported FROM b GROUP BY answer_id) SELECT answer_id, claims, supported, round(supported::DOUBLE / claims, 6) AS groundedness, supported::DOUBLE / claims >= 0.6 AS acceptable FROM g""")
def groundedness(t):
    c = t.conversations
    made = X.groundedness(c.where("role = 'assistant'").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim_id"), F.col("text").alias("claim")), c.where("role <> 'assistant'").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("source_id"), "text"), 0.1)
    return made.withColumn("groundedness", F.round("groundedness", 6))


@query("""WITH a AS (SELECT conv_id * 100 + turn AS answer_id, [CAST(turn AS INT), CAST(turn % 3 AS INT)] AS m FROM conversations), d AS (SELECT answer_id, list_distinct(m) AS m FROM a) SELECT answer_id, CAST(len(m) AS INT) AS cited, CAST(len(list_filter(m, lambda x: x NOT IN (0, 1, 2, 3))) AS INT) AS unknown, len(list_filter(m, lambda x: x NOT IN (0, 1, 2, 3))) = 0 AS valid FROM d""")
def citations(t):
    key = F.col("conv_id") * 100 + F.col("turn")
    answers = t.conversations.select(key.alias("answer_id"), F.concat(F.col("text"), F.lit(" [Doc "), F.col("turn").cast("string"), F.lit("] and [Doc "), (F.col("turn") % 3).cast("string"), F.lit("]")).alias("answer"))
    allowed = t.conversations.select(key.alias("answer_id"), F.explode(F.array(*map(F.lit, range(4)))).alias("index"))
    return X.cited(answers, allowed)


@query("""WITH a AS (SELECT l_orderkey AS id, count(*) AS n, round(avg(l_tax * 11.73), 6) AS trust, round(avg(l_linenumber % 4 + 1), 6) AS grade, count(DISTINCT l_suppkey)::DOUBLE / count(*) AS div, bool_or(l_returnflag = 'R') AS conflict FROM lineitem GROUP BY l_orderkey)
SELECT id, CASE WHEN n >= 3 AND trust >= 0.8 AND grade <= 2 AND NOT conflict THEN 'TOP' WHEN n >= 2 AND trust >= 0.6 AND grade <= 3 THEN 'HIGH' WHEN trust >= 0.4 AND grade <= 4 THEN 'MEDIUM' ELSE 'LOW' END AS label,
round(0.40 * trust + 0.25 * greatest(0.0, 1.0 - (grade - 1.0) / 5.0) + 0.20 * div + 0.15 * least(1.0, n / 3.0), 4)::DOUBLE AS quality FROM a""")
def context_confidence(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("l_tax") * 11.73), 6).alias("trust"), F.round(F.avg(F.col("l_linenumber") % 4 + 1), 6).alias("grade"), (F.countDistinct("l_suppkey") / F.count("*")).alias("div"), F.bool_or(F.col("l_returnflag") == "R").alias("conflict"))
    return rows.select("id", S.confidence(F.col("n"), F.col("trust"), F.col("grade"), F.col("conflict")).alias("label"), S.context_quality(F.col("trust"), F.col("grade"), F.col("div"), F.col("n")).alias("quality"))


URL = """regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"""


@query(f"""WITH p AS (SELECT page_id, lower(regexp_extract(trim(url), '^([A-Za-z]+):', 1)) AS scheme, {URL} AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(string_split(x, '=')[1]), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('yclid', 'ysclid', 'gclid', 'fbclid', 'from', 'fromrss', 'fromtg')), lambda x: replace(url_encode(url_decode(replace(string_split(x, '=')[1], '+', ' '))), '%20', '+') || '=' || replace(url_encode(url_decode(replace(CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END, '+', ' '))), '%20', '+')) AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM k""")
def canonical_url(t):
    return t.pages.select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query(f"WITH p AS (SELECT page_id, {URL} || rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS place FROM pages) SELECT place, min(page_id) AS page_id, count(*) AS copies FROM p GROUP BY place")
def url_dedup(t):
    place = F.concat(F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", ""), F.rtrim(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), F.lit("/")))
    return t.pages.groupBy(place.alias("place")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


UNESCAPED = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
for _k, _v in T.ENTITIES.items():
    UNESCAPED = f"replace({UNESCAPED}, '&{_k};', '" + _v.replace("'", "''") + "')"


@query(f"SELECT page_id, md5(lower(trim(regexp_replace(replace(coalesce({UNESCAPED}, ''), '&amp;', '&'), '\\s+', ' ', 'g')))) AS title_hash FROM pages")
def title_hash(t):
    return t.pages.select("page_id", T.title_hash(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_hash"))


@query()
def html_extract(t):
    return t.pages.select("page_id", T.html_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, coalesce(nullif(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 30)[1], 1, 400), ''), '') AS lead, CAST(greatest(1, length(text) // 2) AS BIGINT) AS tokens, sha256('article:' || doc_id || ',' || n_chars) AS content_hash, substr(text, 1, 280) AS summary FROM documents""")
def document_projection(t):
    d = t.documents
    return d.select("doc_id", F.coalesce(T.first_long_line(F.col("text")), F.lit("")).alias("lead"), T.estimated_tokens(F.col("text")).alias("tokens"), T.content_hash(F.lit("article"), F.array("doc_id", "n_chars")).alias("content_hash"), F.substring("text", 1, 280).alias("summary"))


@query("WITH w AS (SELECT user_id, epoch_us(ts) // 60000000 AS minute, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, minute, n, n > 1 AS limited FROM w")
def rate_limit_fixed_window(t):
    from tidewire.streaming.stateful import rate_windows

    return rate_windows(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), 1, 60)


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, epoch_us(min(ts)) // 1000000 AS started, epoch_us(max(ts)) // 1000000 AS ended, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(t):
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    made = rows.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return made.select("user_id", F.unix_seconds("w.start").alias("started"), F.unix_seconds("last").alias("ended"), "n")


@query("WITH r AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type, event_id % 50 ORDER BY ts, event_id) AS rn FROM events) SELECT event_id FROM r WHERE rn = 1")
def stream_dedupe_batch(t):
    return ranked(t.events.withColumn("url", F.col("event_id") % 50), ["user_id", "event_type", "url"], [F.col("ts"), F.col("event_id")], 1).select("event_id")


@query("""WITH c AS (SELECT conv_id * 100 + turn AS answer_id, conv_id % 7 AS a, turn % 4 AS b FROM conversations), n AS (SELECT answer_id, a, b, unnest(list_distinct(['Agency' || a || ' News', 'Daily' || b || ' Post', 'site' || a || '.example'])) AS source FROM c)
SELECT answer_id, source, source IN ('Agency' || a || ' News', 'site3.example') AS valid FROM n""")
def cited_names(t):
    """Answers that name sources beside a mark, in a closing block and by a phrase; two of three were given."""
    a, b = (F.col("conv_id") % 7).cast("string"), (F.col("turn") % 4).cast("string")
    key = F.col("conv_id") * 100 + F.col("turn")
    text = F.concat(F.lit("Something happened (Agency"), a, F.lit(" News, 2024-01-02, [Doc 1]). По данным Daily"), b, F.lit(" Post, more.\nИсточники:\n1. site"), a, F.lit(".example — title\n- Agency"), a, F.lit(" News: \"A title\" https://x.example/y"))
    answers = t.conversations.select(key.alias("answer_id"), text.alias("answer"))
    given = t.conversations.select(key.alias("answer_id"), F.explode(F.array(F.concat(F.lit("agency"), a, F.lit("  news")), F.lit("site3.example"))).alias("source"))
    return X.cited_names(answers, given)
