"""Articles: feeds of work, neighbours, mentions, clusters and chunk payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators import context as X
from tidewire.operators.retrieval import ranked

#: What extraction may end with, and what of it is worth another try.
TERMINAL, SUCCESSFUL, PENDING = ("ok", "partial", "extraction_failed", "paywall"), ("ok", "partial"), ("partial", "extraction_failed")


def pending(articles: DataFrame, limit: int) -> DataFrame:
    """Articles (id, status, content, published) without content whose extraction may be tried again, newest first."""
    rows = articles.where(F.col("content").isNull() & F.col("status").isin(*PENDING))
    return rows.orderBy(F.desc_nulls_last("published"), F.desc("id")).limit(limit)


def recent(articles: DataFrame, as_of: Column, minutes: int, most: int = 500) -> DataFrame:
    """Processed articles that came in within ``minutes`` before ``as_of``, newest first."""
    rows = articles.where(F.col("processed") & (F.col("ingested") >= as_of - F.expr(f"INTERVAL {minutes} MINUTE")) & (F.col("ingested") <= as_of))
    return rows.orderBy(F.desc("ingested"), F.desc("id")).limit(most)


def known_urls(articles: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(source, url): what each source brought in the last ``hours``."""
    return articles.where((F.col("ingested") >= as_of - F.expr(f"INTERVAL {hours} HOUR")) & (F.col("ingested") <= as_of)).select("source", "url").distinct()


def crawl_order(sources: DataFrame) -> DataFrame:
    """Sources (id, priority) with the place in which they are collected."""
    rank = F.when(F.col("priority") == "continuous", 0).when(F.col("priority") == "periodic", 1).otherwise(2)
    return sources.withColumn("rank", rank).orderBy("rank", "id")


def latest(rows: DataFrame, kinds: dict[str, tuple[Column, int]]) -> DataFrame:
    """(kind, ...): the newest rows (ts, id) of each kind's condition, as many as its number."""
    parts = [rows.where(c).orderBy(F.desc("ts"), F.desc("id")).limit(n).withColumn("kind", F.lit(k)) for k, (c, n) in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) with the total of rows and pages."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    made = rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))
    return made.withColumn("pages", F.ceil(F.col("total") / size))


def related(articles: DataFrame, asked: DataFrame, most: int = 5) -> DataFrame:
    """(id, other, rank): for each article asked for (id), others of its cluster (id, cluster, published), newest first."""
    a = articles.join(asked, "id", "left_semi").where("cluster IS NOT NULL").select("id", "cluster")
    b = articles.select(F.col("id").alias("other"), "cluster", "published")
    # of a cluster only the newest can be shown: one more than asked, for the article itself
    newest = ranked(b.where("cluster IS NOT NULL"), ["cluster"], [F.desc_nulls_last("published"), F.desc("other")], most + 1, "_r").drop("_r")
    return ranked(a.join(newest, "cluster").where("id <> other"), ["id"], [F.desc_nulls_last("published"), F.desc("other")], most).select("id", "other", "rank")


def entity_articles(bridge: DataFrame, entities: DataFrame, known: DataFrame) -> DataFrame:
    """Articles (news_id) that hold one of the entities (entity), without the known ones."""
    return bridge.join(entities.select("entity").distinct(), "entity", "left_semi").select("news_id").distinct().join(known.select("news_id"), "news_id", "left_anti")


def merged_lists(base: DataFrame, extra: DataFrame, limit: int) -> DataFrame:
    """(key, news_id, rank): items of ``base`` then of ``extra`` (key, news_id, rank), each once, up to ``limit``."""
    rows = base.select("key", "news_id", "rank", F.lit(0).alias("part")).unionByName(extra.select("key", "news_id", "rank", F.lit(1).alias("part")))
    first = rows.groupBy("key", "news_id").agg(F.min(F.struct("part", "rank")).alias("at"))
    return ranked(first, ["key"], [F.col("at"), F.col("news_id")], limit).select("key", "news_id", "rank")


def merged_topics(groups: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, topic, confidence, rank): the best confidence of each topic over all groups."""
    best = groups.groupBy("doc_id", "topic").agg(F.max("confidence").alias("confidence"))
    return ranked(best, ["doc_id"], [F.desc("confidence"), F.col("topic")], most)


def zero_shot(scores: DataFrame, least: float = 0.55, top: float = 0.6, most: int = 3) -> DataFrame:
    """(doc_id, topic, confidence, rank) from a model's scores (doc_id, topic, score): none unless the best is sure enough. The model is the caller's (see plugins.py)."""
    rows = ranked(scores.where(F.col("score") >= least), ["doc_id"], [F.desc("score"), F.col("topic")], most)
    sure = F.max("score").over(Window.partitionBy("doc_id")) >= top
    return rows.withColumn("sure", sure).where("sure").select("doc_id", "topic", F.col("score").alias("confidence"), "rank")


def resolved_topics(rules: DataFrame, lexical: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, topic, confidence, origin): topics by rule; of documents without, lexical ones; of those without, the model's."""
    parts, done = [], None
    for origin, rows in (("rule", rules), ("lexical", lexical), ("model", model)):
        own = rows.select("doc_id", "topic", "confidence", F.lit(origin).alias("origin"))
        parts.append(own if done is None else own.join(done, "doc_id", "left_anti"))
        ids = rows.select("doc_id")
        done = ids.distinct() if done is None else done.union(ids).distinct()
    return reduce(DataFrame.unionByName, parts)


def entity_mentions(spans: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(doc_id, entity, kind, mentions, name) from spans (doc_id, pos, text, normal, kind): the first display name stands. aliases: (alias, entity) of normal forms."""
    key = F.lower(F.trim(F.coalesce("normal", "text")))
    rows = spans.withColumn("entity", key).where("entity <> '' AND trim(text) <> ''")
    if aliases is not None:
        known = aliases.select(F.lower("alias").alias("entity"), F.lower("entity").alias("_to"))
        rows = rows.join(known, "entity", "left").withColumn("entity", F.coalesce("_to", "entity")).drop("_to")
    return rows.groupBy("doc_id", "entity", "kind").agg(F.count("*").alias("mentions"), F.min_by(F.trim("text"), "pos").alias("name"))


def mention_ledger(before: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(entity, mentions): counts (entity, n) after old ones of changed articles are taken off and new ones put in, 0 at least."""
    signed = before.select("entity", "n").union(removed.select("entity", -F.col("n"))).union(added.select("entity", "n"))
    return signed.groupBy("entity").agg(F.greatest(F.lit(0), F.sum("n")).alias("mentions"))


def cluster_grades(articles: DataFrame) -> DataFrame:
    """(id, cluster, sources, grade, uncertain, support) of clustered articles (id, cluster, source, reliability): sources are counted once a cluster."""
    counts = articles.where("cluster IS NOT NULL").groupBy("cluster").agg(F.countDistinct("source").alias("sources"))
    rows = articles.join(counts, "cluster")
    return rows.select("id", "cluster", "sources", S.grade(F.col("reliability"), F.col("sources"), F.lit(False)).alias("grade"), S.is_uncertain(F.col("reliability"), F.col("sources")).alias("uncertain"), F.round(F.least(F.lit(1.0), F.col("sources") / 3.0), 4).alias("support"))


def external_signal(a: str, b: str) -> Column:
    """1 for pairs of one story tag, 0.2 for common or mutual related addresses, else 0. a, b: prefixes of the columns story, related and url."""
    urls = lambda p: F.filter(F.transform(F.coalesce(f"{p}related", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    story = F.trim(f"{a}story")
    same = (story != "") & (story == F.trim(f"{b}story"))
    either = F.array(F.coalesce(F.trim(f"{a}url"), F.lit("")), F.coalesce(F.trim(f"{b}url"), F.lit("")))
    near = F.arrays_overlap(urls(a), urls(b)) | F.arrays_overlap(F.array_union(urls(a), urls(b)), either)
    return F.when(F.coalesce(same, F.lit(False)), 1.0).when(F.coalesce(near, F.lit(False)), 0.2).otherwise(0.0)


def chunks(articles: DataFrame, most: int = 420, overlap: int = 70) -> DataFrame:
    """(doc_id, zone, chunk_index, total_chunks, start, end, tokens, text) of articles (doc_id, title, body, fallback): the title, then windows of the body, or of the fallback where that is blank."""
    title = F.trim("title")
    head = articles.where(title != "").select("doc_id", F.lit("title").alias("zone"), F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("start"), F.char_length(title).cast("long").alias("end"), T.token_count(title).alias("tokens"), title.alias("text"))
    text = F.coalesce(F.nullif(F.trim("body"), F.lit("")), F.nullif(F.trim("fallback"), F.lit("")))
    body = X.sentence_chunks(articles.select("doc_id", text.alias("text")).where("text IS NOT NULL"), most, overlap).withColumn("zone", F.lit("body"))
    rows = head.unionByName(body)
    own = Window.partitionBy("doc_id")
    return rows.withColumn("chunk_index", (F.row_number().over(own.orderBy("chunk")) - 1).cast("long")).withColumn("total_chunks", F.count("*").over(own)).drop("chunk")


def processed(articles: DataFrame, topics: DataFrame, entities: DataFrame, keywords: DataFrame, grades: DataFrame, as_of: Column, model: str = "plain", version: str = "1") -> DataFrame:
    """The payload of every chunk: one chain of joins from articles (doc_id, source, title, body, lead, url, language, kind, published, trust) to what an index holds.

    topics (doc_id, topic, confidence), entities (doc_id, name, mentions), keywords (doc_id, term, rank), grades (id, cluster, grade, uncertain, support).
    """
    names = lambda rows, value, order, as_: rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]).alias(as_))
    own = articles.join(names(topics, "topic", [(-F.col("confidence")).alias("_c")], "topics"), "doc_id", "left").join(names(entities, "name", [(-F.col("mentions")).alias("_c")], "entities"), "doc_id", "left")
    own = own.join(names(keywords, "term", [F.col("rank").alias("_c")], "keywords"), "doc_id", "left").join(grades.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    age = (F.unix_micros(as_of) - F.unix_micros("published")) / 3.6e9
    full = F.char_length(F.coalesce("body", F.lit(""))) > 0
    none = F.array().cast("array<string>")
    facts = own.select(
        "doc_id", "source", "title", "url", "language", F.col("kind").alias("information_type"), "published", "trust",
        F.coalesce("grade", F.lit(6)).alias("content_grade"), F.coalesce("uncertain", F.lit(False)).alias("is_uncertain"), F.coalesce("support", F.lit(0.0)).alias("cluster_support"), F.coalesce("cluster", "doc_id").alias("event_cluster_id"),
        F.round(S.value_score(F.col("trust"), age, F.col("kind") == "breaking", full, F.coalesce("sources", F.lit(1))), 4).alias("value_score"), F.round(S.decay(age, F.col("kind")), 4).alias("freshness"), F.when(full, 1.0).otherwise(0.3).alias("completeness"),
        *(F.coalesce(c, none).alias(c) for c in ("topics", "entities", "keywords")), F.coalesce("lead", F.lit("")).alias("snippet_lead"))
    parts = chunks(articles.select("doc_id", "title", "body", F.col("lead").alias("fallback")))
    return parts.join(facts, "doc_id").withColumn("point", T.point_key(F.col("doc_id"), F.col("zone"), F.col("chunk_index").cast("string"), model, version)).withColumn("lemma_text", F.array_join(T.words(F.col("text")), " "))
