"""Page and log queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewire.functions import dom
from tidewire.functions import extract as X
from tidewire.functions import text as T
from tidewire.operators import batches as B
from tidewire.operators.retrieval import ranked
from tidewire.plans.registry import query
from tidewire.sources.store import Scratch, settle


#: How the tables' pages mark their articles.
PAGES = dom.Extractor({"pages": dom.Site(("h1", "p"), roots=("article",), must=True, without=("script", "style", "figure", "noscript", "iframe", "aside", "div.ad"))}, drop=("nav", "div.ad"))


@query()
def extraction_cascade(t):
    """Every third page is of a site whose marks aren't known."""
    known = F.when(F.col("page_id") % 3 > 0, "pages")
    text, status, method = X.levels(F.col("found"))
    rows = t.pages.select("page_id", PAGES.column(F.col("html"), known).alias("found"))
    return rows.select("page_id", text.alias("text"), status.alias("status"), method.alias("method"), F.col("found.blocks").alias("blocks"))


#: The same for short articles: running text and quotes alone, each letter once, and no block with a phrase of a page's controls.
SHORT_PAGES = dom.Extractor({"pages": replace(PAGES.sites["pages"], blocks=("p", "blockquote"), noise=dom.CONTROLS, least=dom.SHORT["ria"].least, once=True)}, drop=(*PAGES.drop, *PAGES.sites["pages"].without))


@query()
def short_safe_articles(t):
    text, status = X.short_safe(F.col("found"))
    return t.pages.select("page_id", SHORT_PAGES.column(F.col("html"), F.lit("pages")).alias("found")).select("page_id", text.alias("text"), status.alias("status"))


@query()
def turbo_articles(t):
    """An article's own markup as the structured part, the page as what may replace it."""
    inner = F.regexp_extract("html", "(?s)<article[^>]*>(.*)</article>", 1)
    rows = t.pages.select("page_id", dom.structured_blocks(inner, F.lit("")).alias("turbo"), PAGES.column(F.col("html"), F.lit(None).cast("string")).alias("found"))
    text = F.array_join(F.filter(F.transform("turbo", lambda b: F.when(b["kind"] != "image", b["text"])), lambda x: x.isNotNull()), "\n\n")
    chosen, status, reason = X.turbo_or_page(text, F.size(F.filter("turbo", lambda b: b["kind"] == "paragraph")), F.col("found.precise"), F.lit(500))
    return rows.select("page_id", chosen.alias("text"), status.alias("status"), reason.alias("reason"), F.size("turbo").alias("blocks"))


@query(r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(script|style)\b[^>]*>).*?</(script|style)>', '\1', 'gs') AS h FROM pages),
e AS (SELECT page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM c) SELECT page_id, tag, count(*) AS n FROM e GROUP BY page_id, tag""")
def page_elements(t):
    return t.pages.select("page_id", F.explode(dom.element_counts(F.col("html"))).alias("e")).select("page_id", "e.*")


@query()
def extraction_compare(t):
    made = X.compared(T.html_text(F.col("html")), X.paragraphs(F.col("html")), ("cookie", "subscribe", "menu"))
    return t.pages.select("page_id", made.alias("c")).select("page_id", "c.*")


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, 'Licen[cs]ed|MIT License') AND NOT starts_with(ltrim(x), 'The ')), chr(10)) AS text FROM documents")
def post_rules(t):
    return t.documents.select("doc_id", X.apply_rules(F.col("text"), [("drop_lines_matching", "Licen[cs]ed|MIT License"), ("drop_lines_starting", "The ")]).alias("text"))


@query("SELECT c_custkey AS id, CASE lower(c_mktsegment) WHEN 'building' THEN 'analysis' WHEN 'machinery' THEN 'press' ELSE 'news' END AS content_type, CASE lower(c_mktsegment) WHEN 'building' THEN 'analytics' WHEN 'machinery' THEN 'reference' ELSE 'daily' END AS information_type FROM customer")
def source_taxonomy(t):
    kind, info = X.taxonomy(F.col("c_mktsegment"), {"building": ("analysis", "analytics"), "machinery": ("press", "reference")})
    return t.customer.select(F.col("c_custkey").alias("id"), kind.alias("content_type"), info.alias("information_type"))


@query("""WITH s AS (SELECT user_id AS search_id, event_id AS news_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS position FROM events), k AS (SELECT * FROM s WHERE position <= 5),
c AS (SELECT user_id AS search_id, event_id AS news_id, event_type = 'click' AS clicked FROM events) SELECT k.search_id, k.news_id, k.position, c.clicked FROM k JOIN c ON k.search_id = c.search_id AND k.news_id = c.news_id""")
def search_log(t):
    shown = ranked(t.events.select(F.col("user_id").alias("search_id"), F.col("event_id").alias("news_id"), "value", (F.col("event_type") == "click").alias("clicked")), ["search_id"], [F.desc("value"), F.col("news_id")], 5, "position")
    # the log holds one ordered list a search; impressions are its elements
    lists = shown.groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct("position", "news_id", "clicked"))).alias("results"))
    return lists.select("search_id", F.posexplode("results").alias("p", "r")).select("search_id", "r.news_id", (F.col("p") + 1).cast("long").alias("position"), "r.clicked")


WAITING = """b AS (SELECT doc_id AS id, source, doc_id % 3 > 0 AS waits, CASE WHEN doc_id % 13 = 0 THEN 403 WHEN doc_id % 17 = 0 THEN 500 WHEN doc_id % 19 > 0 THEN 200 END AS code, trim(regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '\\s+', ' ', 'g')) AS t0 FROM documents),
w AS (SELECT *, regexp_replace(t0, '\\s+([,.:;!?])', '\\1', 'g') AS t FROM b WHERE waits QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC) <= 20),
r AS (SELECT id, source, code, CASE WHEN code = 200 AND length(t) >= 200 THEN t WHEN code = 200 AND length(t) >= 100 THEN t END AS content, CASE WHEN code = 200 THEN CASE WHEN length(t) >= 200 THEN 'ok' WHEN length(t) >= 100 THEN 'partial' ELSE 'extraction_failed' END WHEN code = 403 THEN 'paywall' ELSE 'extraction_failed' END AS status,
CASE WHEN code = 200 THEN CASE WHEN length(t) >= 200 THEN 'site' WHEN length(t) >= 100 THEN 'recall' ELSE 'failed_all_levels' END ELSE 'http_error' END AS method FROM w)"""


def waiting(t):
    """Documents as articles of which two thirds wait, and their pages as they might be answered."""
    i = F.col("doc_id")
    page = F.concat(F.lit("<html><nav>Home</nav><article><p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p></article></html>"))
    articles = t.documents.select(i.alias("id"), "source", F.lit("pages").alias("site"), i.cast("string").alias("url"), F.lit("").alias("title"), i.alias("published"), F.when(i % 3 == 0, "text").alias("content"), F.when(i % 3 == 1, "partial").otherwise("extraction_failed").alias("status"))
    pages = t.documents.select(i.cast("string").alias("url"), F.when(i % 13 == 0, 403).when(i % 17 == 0, 500).when(i % 19 > 0, 200).alias("code"), page.alias("html"))
    return articles, B.enriched(B.pending(articles, 20), pages, PAGES)


@query(f"WITH {WAITING} SELECT id, source, content, status, method, code AS http_status FROM r")
def enriched_articles(t):
    return waiting(t)[1].drop("tags")


@query(f"""WITH {WAITING}, m AS (SELECT DISTINCT source FROM b WHERE waits AND id NOT IN (SELECT id FROM r WHERE content IS NOT NULL OR status = 'paywall')), c AS (SELECT source, count(*) AS total, count(content) AS good FROM r GROUP BY source), a AS (SELECT DISTINCT source FROM documents)
SELECT a.source, coalesce(total, 0) AS items_total, coalesce(good, 0) AS items_enriched, coalesce(total - good, 0) AS items_failed, CASE WHEN total > good THEN 'partial' ELSE 'success' END AS status,
coalesce(total, 0) > 0 AND (coalesce(good, 0) > 0 OR total = good) AND (a.source LIKE '%1' OR m.source IS NOT NULL) AS followup_needed FROM a LEFT JOIN c ON a.source = c.source LEFT JOIN m ON a.source = m.source""")
def enrichment_runs(t):
    articles, done = waiting(t)
    asked = t.documents.select("source").distinct().withColumn("rerun_requested", F.col("source").endswith("1"))
    return B.enrichment_runs(articles, settle(done), asked)


def measured(batch):
    """A page's number of elements; pages with a number that 9 divides are taken for broken."""
    import pyarrow as pa

    ids = batch["page_id"].to_pylist()
    if bad := [i for i in ids if i % 9 == 0]:
        raise ValueError(f"page {bad[0]}")
    return pa.RecordBatch.from_arrays([batch["page_id"], pa.array([sum(1 for x in dom.read(h) if x.tag == "article") for h in batch["html"].to_pylist()], pa.int64())], ["page_id", "n"])


@query("SELECT page_id, CASE WHEN page_id % 9 > 0 THEN len(regexp_extract_all(html, '<article[ >]'))::BIGINT END AS n, CASE WHEN page_id % 9 = 0 THEN 'ValueError: page ' || page_id END AS error FROM pages")
def isolated_batch(t):
    """Rows that fail stand apart, each with its own error; the others of their batches come through."""
    good, dead, _ = B.run_batch(t.pages.select("page_id", "html"), measured, "page_id long, n long", "page_id", Scratch(t.spark))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(dead.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("long").alias("n"), "error"))
