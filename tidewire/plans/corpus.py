"""Corpus queries over documents, benchmark (as queries) and lineitem (as item-entity bridge)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import corpus as C
from tidewire.operators import index as X
from tidewire.operators import keyphrases as K
from tidewire.operators import matching as M
from tidewire.plans.registry import query
from tidewire.sources.store import Scratch, settle

WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
STOP = ", ".join(f"'{x}'" for x in T.STOP_TERMS)
SHORT = ", ".join(f"'{x}'" for x in T.SHORT_TERMS)
CODE = ", ".join(f"'{x}'" for x in T.CODE_TERMS)


def useful(t: str) -> str:
    """SQL for an informative term (tokens hold letters and digits only)."""
    return f"({t} NOT IN ({STOP}) AND {t} NOT IN ({CODE}) AND NOT regexp_full_match({t}, '\\p{{N}}+') AND (length({t}) >= 3 OR {t} IN ({SHORT})) AND length({t}) <= 64 AND regexp_matches({t}, '\\p{{L}}'))"


TERMS = f"t AS (SELECT doc_id, unnest(list_filter({WORDS}, lambda w: length(w) >= 2)) AS term FROM documents)"
VOCABULARY = f"{TERMS}, v AS (SELECT replace(term, 'ё', 'ё') AS term, count(DISTINCT doc_id) AS doc_frequency, count(*) AS collection_frequency FROM t GROUP BY term HAVING count(*) >= 3 AND {useful('term')})"


@query(f"WITH {VOCABULARY} SELECT * FROM v")
def term_vocabulary(t):
    return C.vocabulary(t.documents)


COLLOCATIONS = f"""{TERMS}, l AS (SELECT list_filter({WORDS}, lambda w: length(w) >= 2) AS w FROM (SELECT unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS text FROM documents)),
p0 AS (SELECT unnest(list_zip(w[1:len(w)-1], w[2:len(w)])) AS p FROM l WHERE len(w) > 1),
p AS (SELECT p[1] AS a, p[2] AS b, count(*) AS n FROM p0 WHERE p[1] <> p[2] AND {useful('p[1]')} AND {useful('p[2]')} GROUP BY ALL),
s AS (SELECT term, count(*) AS n FROM t WHERE {useful('term')} GROUP BY term),
c AS (SELECT a AS term_a, b AS term_b, ln((p.n::DOUBLE / (SELECT sum(n) FROM p)) / ((x.n::DOUBLE / (SELECT sum(n) FROM s)) * (y.n::DOUBLE / (SELECT sum(n) FROM s)))) AS pmi, p.n AS frequency
      FROM p JOIN s x ON x.term = a JOIN s y ON y.term = b WHERE p.n >= 5),
k AS (SELECT term_a, term_b, round(pmi, 4) AS pmi_score, frequency FROM c WHERE pmi >= 3.0)"""


@query(f"WITH {COLLOCATIONS} SELECT * FROM k")
def collocations_pmi(t):
    return C.collocations(t.documents)


TFIDF = """t AS (SELECT doc_id, unnest(list_filter({w}, lambda w: length(w) >= {n})) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
z AS (SELECT doc_id, sum(tf) AS size FROM f GROUP BY doc_id), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
x AS (SELECT f.doc_id, f.term, f.tf::DOUBLE / z.size * ln((SELECT count(*) FROM documents)::DOUBLE / d.df) AS weight FROM f JOIN z ON f.doc_id = z.doc_id JOIN d ON f.term = d.term)"""


@query(f"WITH {TFIDF.format(w=WORDS, n=4)}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM x) SELECT doc_id, term, round(weight, 6) AS weight, rank FROM r WHERE rank <= 8")
def keywords_tfidf(t):
    return C.keywords(t.documents).withColumn("weight", F.round("weight", 6))


SPARSE = f"""t AS (SELECT doc_id, unnest(list_filter({WORDS}, lambda w: length(w) >= 2)) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
z AS (SELECT doc_id, sum(tf) AS size FROM f GROUP BY doc_id),
s AS (SELECT f.doc_id, CAST('0x' || substr(sha256(f.term), 1, 8) AS BIGINT) AS idx, round(sum(f.tf::DOUBLE / z.size), 6) AS val FROM f JOIN z ON f.doc_id = z.doc_id GROUP BY ALL)"""


@query(f"WITH {SPARSE} SELECT * FROM s")
def sparse_vectors(t):
    return C.sparse_vectors(t.documents)


QUERY_TERMS = "q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 3)) AS term FROM benchmark)"


@query(f"""WITH {QUERY_TERMS}, {SPARSE}, h AS (SELECT query_id, CAST('0x' || substr(sha256(term), 1, 8) AS BIGINT) AS idx, count(*)::DOUBLE AS w FROM q GROUP BY ALL),
r AS (SELECT query_id, doc_id, sum(val * w) AS score FROM s JOIN h ON s.idx = h.idx GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM o WHERE rank <= 20""")
def tfidf_sparse_search(t):
    q = settle(C.query_terms(t.benchmark.select(F.col("item_id").alias("query_id"), "text")))
    index = q.groupBy("query_id", T.hash_number(F.col("term")).alias("idx")).agg(F.count("*").cast("double").alias("val"))
    return C.best_sparse(settle(C.postings(t.documents, wanted=q)), index, 20).withColumn("score", F.round("score", 6))


BM25 = f"""{QUERY_TERMS}, t AS (SELECT doc_id, unnest(list_filter({WORDS}, lambda w: length(w) >= 3)) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
z AS (SELECT doc_id, len(list_filter({WORDS}, lambda w: length(w) >= 3)) AS size FROM documents), m AS (SELECT avg(size) AS mean, count(*) AS docs FROM z),
w AS (SELECT f.doc_id, f.term, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / mean)) AS w FROM f JOIN d ON f.term = d.term JOIN z ON f.doc_id = z.doc_id, m),
r AS (SELECT query_id, doc_id, sum(w) AS score FROM w JOIN q ON w.term = q.term GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r)"""


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM o WHERE rank <= 20")
def bm25_search(t):
    return C.bm25(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 20).withColumn("score", F.round("score", 6))


@query(f"""WITH {VOCABULARY}, a AS (SELECT term, doc_frequency FROM v WHERE regexp_full_match(term, '[a-z]+') AND length(term) >= 5 AND doc_frequency >= 5),
w AS (SELECT DISTINCT substr(term, 1, 2) || substr(term, 4) AS word FROM a WHERE length(term) >= 8), u AS (SELECT word FROM w WHERE word NOT IN (SELECT term FROM a)),
g AS (SELECT word, list_distinct(list_transform(range(1, length(word) + 1), lambda i: substr('^' || word || '$', i, 3))) AS grams FROM u),
h AS (SELECT term, doc_frequency, list_distinct(list_transform(range(1, length(term) + 1), lambda i: substr('^' || term || '$', i, 3))) AS grams FROM a),
ge AS (SELECT word, len(grams) AS n, unnest(grams) AS gram FROM g), he AS (SELECT term, doc_frequency, len(grams) AS m, unnest(grams) AS gram FROM h),
b AS (SELECT word, term, n, m, doc_frequency, count(*) AS shared FROM ge JOIN he ON ge.gram = he.gram GROUP BY ALL),
c AS (SELECT word, term, doc_frequency, levenshtein(word, term) AS distance FROM b WHERE shared::DOUBLE / (n + m - shared) >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, doc_frequency DESC, term) AS r FROM c) SELECT word, term AS corrected, distance FROM r WHERE r = 1 AND distance <= 2""")
def query_autocorrect_candidates(t):
    vocab = settle(C.vocabulary(t.documents).where("term RLIKE '^[a-z]+$' AND char_length(term) >= 5 AND doc_frequency >= 5"))
    typos = vocab.where("char_length(term) >= 8").select(F.concat(F.substring("term", 1, 2), F.expr("substring(term, 4)")).alias("word"))
    return M.autocorrect(typos, vocab)


@query(f"""WITH {VOCABULARY}, k AS (SELECT term FROM v WHERE regexp_full_match(term, '[a-zäöüßéèñóíá]+') AND length(term) >= 6 ORDER BY collection_frequency DESC, term LIMIT 400) SELECT doc_id AS id, term AS pattern FROM documents, k WHERE contains(lower(text), term)""")
def texts_with_keywords(t):
    """The 400 commonest longer terms, anywhere in every text."""
    terms = C.vocabulary(t.documents).where("term RLIKE '^[a-zäöüßéèñóíá]+$' AND char_length(term) >= 6").orderBy(F.desc("collection_frequency"), "term").limit(400)
    return M.contained(t.documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), terms.select(F.col("term").alias("pattern")))


CORRECTED = f"""WITH {VOCABULARY}, a AS (SELECT term, doc_frequency FROM v WHERE length(term) >= 3 AND doc_frequency >= 20), q0 AS (SELECT item_id AS query_id, string_split_regex(trim(text), '\\s+') AS ws FROM benchmark),
q1 AS (SELECT query_id, unnest(range(len(ws))) AS place, unnest(ws) AS w FROM q0), q AS (SELECT query_id, place, CASE WHEN place % 3 = 0 AND length(w) > 6 THEN substr(w, 1, 2) || substr(w, 4) ELSE w END AS w FROM q1 WHERE w <> ''),
y AS (SELECT *, CASE WHEN length(w) >= 3 AND regexp_full_match(w, '[A-Za-zА-Яа-яЁё-]+') AND lower(w[1]) = w[1] AND {useful('lower(w)')} THEN lower(w) END AS word FROM q), u AS (SELECT DISTINCT word FROM y WHERE word IS NOT NULL AND word NOT IN (SELECT term FROM a)),
g AS (SELECT word, list_distinct(list_transform(range(1, length(word) + 1), lambda i: substr('^' || word || '$', i, 3))) AS grams FROM u), h AS (SELECT term, doc_frequency, list_distinct(list_transform(range(1, length(term) + 1), lambda i: substr('^' || term || '$', i, 3))) AS grams FROM a),
b AS (SELECT word, term, n, m, doc_frequency, count(*) AS shared FROM (SELECT word, len(grams) AS n, unnest(grams) AS gram FROM g) JOIN (SELECT term, doc_frequency, len(grams) AS m, unnest(grams) AS gram FROM h) USING (gram) GROUP BY ALL),
c AS (SELECT word, term, levenshtein(word, term) AS distance, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), doc_frequency DESC, term) AS r FROM b WHERE shared::DOUBLE / (n + m - shared) >= 0.5), k AS (SELECT word, term FROM c WHERE r = 1 AND distance <= 2)
SELECT query_id, string_agg(coalesce(term, w), ' ' ORDER BY place) AS corrected, bool_or(term IS NOT NULL) AS was_corrected FROM y LEFT JOIN k USING (word) GROUP BY query_id"""


@query(CORRECTED)
def corrected_queries(t):
    return M.corrected_queries(spoilt_queries(t), C.vocabulary(t.documents).where("char_length(term) >= 3 AND doc_frequency >= 20"))


def spoilt_queries(t):
    """Every third longer word of a query lacks a letter. Places count what stands before a leading line break, as in the SQL."""
    spoilt = "array_join(filter(transform(split(trim(text), '\\\\s+'), (w, i) -> IF(i % 3 = 0 AND char_length(w) > 6, concat(substring(w, 1, 2), substring(w, 4)), w)), w -> w <> ''), ' ')"
    return t.benchmark.selectExpr("item_id AS query_id", f"{spoilt} AS text")


@query(f"WITH {VOCABULARY} SELECT * FROM v WHERE lower(term) LIKE 'th%' ORDER BY doc_frequency DESC, collection_frequency DESC, term LIMIT 10")
def suggest_prefix(t):
    return C.suggestions(C.vocabulary(t.documents), "th")


EXPANDED = f"""WITH {COLLOCATIONS}, e AS (SELECT term_a, term_b, round(pmi_score * ln(1 + frequency), 6) AS weight FROM k WHERE (length(term_a) >= 4 OR term_a IN ({SHORT})) AND (length(term_b) >= 4 OR term_b IN ({SHORT}))),
q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS tokens FROM benchmark), i AS (SELECT query_id, tokens, unnest(tokens) AS token FROM q),
f AS (SELECT query_id, tokens, term_a, term_b, weight FROM i JOIN e ON token = term_a UNION ALL SELECT query_id, tokens, term_a, term_b, weight FROM i JOIN e ON token = term_b),
n AS (SELECT DISTINCT query_id FROM f WHERE list_contains(tokens, term_a) AND list_contains(tokens, term_b)),
g AS (SELECT DISTINCT query_id, term_a || ' ' || term_b AS phrase, weight FROM f WHERE query_id NOT IN (SELECT query_id FROM n)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, phrase) AS rank FROM g) SELECT query_id, phrase, weight, rank FROM o WHERE rank <= 3"""


@query(EXPANDED)
def query_expansion(t):
    return C.expansions(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), C.collocations(t.documents))


#: Fixture rules: topic, position, marker.
RULES = (("alpha", 0, "tion"), ("alpha", 0, "thand"), ("alpha", 0, "and the"), ("beta", 1, "der"), ("beta", 1, "enheit"), ("beta", 1, "und die"), ("gamma", 2, "que"), ("gamma", 2, "ement"), ("delta", 3, "los"), ("delta", 3, "ciones"))
RULE_VALUES = ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in RULES)


def rules_of(t):
    return t.spark.createDataFrame(RULES, "topic string, position int, marker string")


@query(f"""WITH m(topic, position, marker) AS (VALUES {RULE_VALUES}), d AS (SELECT doc_id, lower(substr(text, 1, 1200)) AS low FROM documents), e AS (SELECT *, regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+') AS tokens FROM d),
h AS (SELECT doc_id, topic, position, count(*) AS hits FROM e, m WHERE CASE WHEN length(marker) >= 5 OR contains(marker, ' ') THEN contains(low, marker) ELSE list_contains(tokens, marker) END GROUP BY ALL),
c AS (SELECT *, round(least(0.9, 0.62 + 0.08 * hits)::DOUBLE, 4) AS confidence FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, position) AS rank FROM c)
SELECT doc_id, topic, hits, confidence, rank FROM r WHERE rank <= 3""")
def lexical_topic_scores(t):
    return C.lexical_topics(t.documents, rules_of(t))


@query("""WITH m(topic, rule, marker) AS (VALUES ('web', 0, 'example'), ('list', 1, 'page'), ('reference', 2, 'ref'), ('any', 3, 'http')), c AS (SELECT page_id AS doc_id, 0 AS position, lower(url) AS category FROM pages),
x AS (SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id ORDER BY rule) AS r FROM c, m WHERE contains(category, marker)) SELECT doc_id, topic, 0.95::DOUBLE AS confidence FROM x WHERE r = 1""")
def topic_rules(t):
    rules = t.spark.createDataFrame([("web", 0, "example"), ("list", 1, "page"), ("reference", 2, "ref"), ("any", 3, "http")], "topic string, rule int, marker string")
    return C.topic_rules(t.pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("position"), F.col("url").alias("category")), rules)


EDGES = """i AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS entity FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY entity) AS r FROM i), k AS (SELECT * FROM n WHERE r <= 10),
e AS (SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM k x JOIN k y ON x.item = y.item AND x.entity < y.entity GROUP BY ALL)"""


def edges_of(t):
    return C.cooccurrence(t.lineitem.select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("entity")))


@query(f"WITH {EDGES} SELECT * FROM e")
def cooccurrence_edges(t):
    return edges_of(t)


@query(f"""WITH {EDGES}, s AS (SELECT p_partkey AS entity FROM part WHERE p_size = 1), o AS (SELECT b AS entity, weight FROM e WHERE a IN (SELECT entity FROM s) UNION ALL SELECT a, weight FROM e WHERE b IN (SELECT entity FROM s)),
g AS (SELECT entity, CAST(sum(weight) AS BIGINT) AS weight FROM o WHERE entity NOT IN (SELECT entity FROM s) GROUP BY entity ORDER BY weight DESC, entity LIMIT 50),
w AS (SELECT DISTINCT l_orderkey AS news_id, g.entity, g.weight FROM lineitem JOIN g ON l_partkey = g.entity), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY news_id) AS rank FROM w) SELECT * FROM r WHERE rank <= 5""")
def graph_expansion(t):
    from pyspark.sql import Window

    near = C.expand_edges(edges_of(t), t.part.where("p_size = 1").select(F.col("p_partkey").alias("entity")), 50)
    news = t.lineitem.join(near, F.col("l_partkey") == F.col("entity")).select(F.col("l_orderkey").alias("news_id"), "entity", "weight").distinct()
    return news.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("news_id")).cast("long")).where("rank <= 5")


@query("""SELECT conv_id, turn, CASE WHEN b > a THEN 'CAPABILITY' WHEN a > 0 THEN 'INTENT' ELSE 'FACTUAL' END AS intent, CASE WHEN q = '' THEN 0.5 WHEN greatest(a, b) = 0 THEN 0.6 ELSE round(least(0.95, 0.6 + greatest(a, b) * 0.15)::DOUBLE, 2) END AS confidence
FROM (SELECT *, contains(q, 'the')::INT + contains(q, 'und')::INT + contains(q, 'que')::INT AS a, contains(q, 'tion')::INT + contains(q, 'der')::INT AS b FROM (SELECT conv_id, turn, lower(trim(text)) AS q FROM conversations))""")
def intent_classify(t):
    name, sure = T.intent(F.col("text"), (("INTENT", ("the", "und", "que")), ("CAPABILITY", ("tion", "der"))))
    return t.conversations.select("conv_id", "turn", name.alias("intent"), sure.cast("double").alias("confidence"))


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM o WHERE rank <= 20")
def indexed_search(t):
    """As ``bm25_search``, by the terms that can lead to results."""
    made = X.built(t.documents, Scratch(t.spark))
    return X.search(made, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 20).withColumn("score", F.round("score", 6))


@query(f"""WITH {BM25}, p AS (SELECT o.*, CASE WHEN doc_id % 7 > 0 THEN doc_id % 50 END AS published FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, published DESC NULLS LAST, doc_id DESC) AS place FROM p)
SELECT query_id, doc_id, round(score, 6) AS score, place AS rank FROM k WHERE place <= 20""")
def full_text_by_date(t):
    """Ties by date: copies of a text have equal scores."""
    day = F.when(F.col("doc_id") % 7 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 50).cast("int")))
    made = X.built(t.documents, Scratch(t.spark))
    return X.search(made, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 20, t.documents.select("doc_id", day.alias("published_at"))).withColumn("score", F.round("score", 6))


_ASKED = "FROM (SELECT query_id AS item_id, corrected AS text FROM cq)"


@query(f"""WITH cq AS MATERIALIZED ({CORRECTED}), ex AS MATERIALIZED ({EXPANDED.replace("FROM benchmark", _ASKED)}), bm AS MATERIALIZED (WITH {BM25.replace("FROM benchmark", _ASKED)} SELECT query_id, doc_id AS id, rank FROM o WHERE rank <= 20),
wd AS (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(corrected), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3)) AS term FROM cq UNION SELECT query_id, unnest(list_filter(regexp_extract_all(lower(phrase), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3)) FROM ex),
sp AS (WITH {SPARSE}, h AS (SELECT query_id, CAST('0x' || substr(sha256(term), 1, 8) AS BIGINT) AS idx, count(*)::DOUBLE AS w FROM wd GROUP BY ALL), r AS (SELECT query_id, doc_id AS id, sum(val * w) AS score FROM s JOIN h ON s.idx = h.idx GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM r) SELECT query_id, id, rank FROM o WHERE rank <= 30),
un AS (SELECT query_id, 0 AS list, id, rank FROM sp UNION ALL SELECT query_id, 1, id, rank FROM bm), un1 AS (SELECT *, min(list) OVER (PARTITION BY query_id) AS low FROM un QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY list, rank) = 1),
pl AS (SELECT query_id, id, CASE WHEN list = 0 THEN 'hybrid' WHEN low = 0 THEN 'supplement' ELSE 'fallback' END AS mode, row_number() OVER (PARTITION BY query_id ORDER BY list, rank) AS position FROM un1), xs AS (SELECT query_id, string_agg(phrase, '; ' ORDER BY rank) AS e FROM ex GROUP BY query_id)
SELECT query_id, corrected, was_corrected, coalesce(e, '') AS expansions, id, position, mode FROM pl JOIN cq USING (query_id) LEFT JOIN xs USING (query_id)""")
def search_candidates(t):
    from tidewire.operators import pipelines

    vocab = C.vocabulary(t.documents).where("char_length(term) >= 3 AND doc_frequency >= 20")
    return pipelines.candidates(t.documents, spoilt_queries(t), vocab, C.collocations(t.documents)).withColumn("expansions", F.array_join("expansions", "; "))


@query(f"""WITH st AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?\\n]+')) AS s, generate_subscripts(string_split_regex(text, '[.!?\\n]+'), 1) AS p FROM documents WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 20),
sw AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS s, w FROM (SELECT doc_id, p, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+') AS w FROM st) WHERE len(w) > 0), sn AS (SELECT doc_id, count(*) AS n FROM sw GROUP BY doc_id),
tk AS MATERIALIZED (SELECT doc_id, s, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, lower(unnest(w)) AS low, lower(unnest(list_concat([NULL], w[1:len(w) - 1]))) AS l, lower(unnest(list_concat(w[2:], [NULL]))) AS r FROM sw),
ag AS (SELECT doc_id, low, count(*)::DOUBLE AS tf, sum(s)::DOUBLE AS place, count(DISTINCT s)::DOUBLE AS k, count(*) FILTER (length(word) > 1 AND upper(word) = word AND lower(word) <> word) AS shout,
  count(*) FILTER (i > 1 AND upper(word[1]) = word[1] AND lower(word[1]) <> word[1] AND NOT (length(word) > 1 AND upper(word) = word)) AS cap, count(DISTINCT l)::DOUBLE / greatest(1, count(l)) AS dl, count(DISTINCT r)::DOUBLE / greatest(1, count(r)) AS dr FROM tk GROUP BY ALL),
gd AS (SELECT *, avg(tf) OVER d AS mean, stddev_pop(tf) OVER d AS dev, max(tf) OVER d AS most FROM ag WHERE {useful("replace(low, 'ё', 'е')")} WINDOW d AS (PARTITION BY doc_id)),
wt AS MATERIALIZED (SELECT doc_id, low, ln(ln(3 + place / tf)) * near / (greatest(cap, shout) / (1 + ln(tf)) + (tf / (mean + dev) + k / n) / near) AS w FROM (SELECT gd.*, n, 1 + (dl + dr) * tf / most AS near FROM gd JOIN sn USING (doc_id))),
x AS MATERIALIZED (SELECT tk.doc_id, s, i, low, w FROM tk JOIN wt USING (doc_id, low)), g AS (SELECT doc_id, low AS phrase, w AS pr, w AS su FROM x UNION ALL SELECT a.doc_id, a.low || ' ' || b.low, a.w * b.w, a.w + b.w FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.s = b.s AND b.i = a.i + 1
  UNION ALL SELECT a.doc_id, a.low || ' ' || b.low || ' ' || c.low, a.w * b.w * c.w, a.w + b.w + c.w FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.s = b.s AND b.i = a.i + 1 JOIN x c ON a.doc_id = c.doc_id AND a.s = c.s AND c.i = a.i + 2),
sc AS (SELECT doc_id, phrase, round(max(pr) / ((1 + max(su)) * count(*)), 9) AS score FROM g GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, phrase) AS rank FROM sc) SELECT doc_id, phrase, round(score, 5) AS score, rank FROM rk WHERE rank <= 8""")
def keyphrases(t):
    """Without leaving out alike ones, which SQL can't say; a test does that."""
    return K.of_documents(t.documents, 8, alike=1.0).withColumn("score", F.round("score", 5))


@query()
def keyphrases_apart(t):
    return K.of_documents(t.documents, 8, highest=0.15)
