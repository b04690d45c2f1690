"""Whole paths: search over batches of queries, and ranking for a user. Each is one plan of the operators beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators import corpus as C
from tidewire.operators import matching as M
from tidewire.operators import personal as P
from tidewire.operators import retrieval as R
from tidewire.sources.store import settle


def candidates(docs: DataFrame, queries: DataFrame, vocab: DataFrame, coll: DataFrame, depth: int = 30, supplement: int = 20) -> DataFrame:
    """(query_id, corrected, was_corrected, expansions, id, position, mode): what may answer each query (query_id, text).

    Likely typos are corrected, collocations of the corrected words expand the sparse query, and full text adds ``supplement`` documents
    behind the ``depth`` of the sparse list; a document of both stands where the first has it. Mode is ``hybrid``, ``supplement``, or ``fallback`` where full text alone found something.
    """
    fixed = settle(M.corrected_queries(queries, vocab))
    asked = fixed.select("query_id", F.col("corrected").alias("text"))
    phrases = settle(C.expansions(asked, coll))
    lists = C.lexical_and_sparse(docs, asked, max(depth, supplement), phrases.select("query_id", F.explode(T.words(F.col("phrase"), 3)).alias("term")))
    rows = lists.where(((F.col("list") == "sparse") & (F.col("rank") <= depth)) | ((F.col("list") == "lexical") & (F.col("rank") <= supplement)))
    place = F.when(F.col("list") == "sparse", 0).otherwise(1)
    one = R.merged(rows.select("query_id", place.alias("list"), "id", F.col("rank").alias("position")))
    mode = F.when(F.col("list") == 0, "hybrid").when(F.min("list").over(Window.partitionBy("query_id")) == 0, "supplement").otherwise("fallback")
    made = R.ranked(one.withColumn("mode", mode), ["query_id"], [F.col("list"), F.col("position")], name="at")
    by_query = phrases.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("expansions"))
    return made.join(fixed, "query_id").join(by_query, "query_id", "left").select("query_id", "corrected", "was_corrected", F.coalesce("expansions", F.array().cast("array<string>")).alias("expansions"), "id", F.col("at").alias("position"), "mode")


def one_a_cluster(results: DataFrame, clusters: DataFrame, limit: int) -> DataFrame:
    """The results (query_id, news_id, score, ...), ranked anew, with the best of each event cluster (id, cluster) alone; those without one stand for themselves."""
    rows = results.drop("rank").join(clusters.select(F.col("id").alias("news_id"), "cluster"), "news_id", "left").withColumn("_c", F.coalesce("cluster", -F.col("news_id") - 1)).drop("cluster")
    order = [F.desc("score"), F.col("news_id")]
    return R.ranked(R.ranked(rows, ["query_id", "_c"], order, 1, "_r").drop("_r", "_c"), ["query_id"], order, limit)


def search(articles: DataFrame, queries: DataFrame, limit: int = 10, depth: int = 30, rerank: DataFrame | None = None, coll: DataFrame | None = None, found: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(query_id, news_id, score, retrieval, rank, snippet, explanation): the best articles of each query (query_id, query).

    articles: doc_id, text, title, lead, source, zone, trust, grade, freshness, value. Lexical and sparse lists are fused, the best ``depth`` of each
    query keep their place for scoring, and the final score blends relevance, trust, grade, freshness and the match of words.
    rerank: (query_id, id, rerank_score) of a model; others are neutral (0.5). coll: collocations whose phrases expand the sparse query.
    found: ``candidates``, in place of the fused lists: queries as corrected, their positions as ranks, expansions and modes in the explanation. clusters: (id, cluster), of which the best alone is shown.
    """
    if found is not None:
        queries = queries.select("query_id").join(found.select("query_id", F.col("corrected").alias("query")).distinct(), "query_id")
        rows = R.normalised(found.select("query_id", "id", (1.0 / (60 + F.col("position"))).alias("score"), "mode", "expansions"))
    else:
        asked = queries.select("query_id", F.col("query").alias("text"))
        more = C.expansions(asked, coll).select("query_id", F.explode(T.words(F.col("phrase"), 3)).alias("term")) if coll is not None else None
        lists = C.lexical_and_sparse(articles, asked, depth, more)
        rows = R.normalised(R.fused(lists, 60, depth).drop("rank")).withColumn("mode", F.lit("hybrid")).withColumn("expansions", F.array().cast("array<string>"))
    if rerank is not None:
        rows = rows.join(rerank, ["query_id", "id"], "left")
    rows = rows.withColumn("rerank", F.coalesce("rerank_score", F.lit(0.5)) if rerank is not None else F.lit(0.5))
    rows = rows.join(queries.select("query_id", "query", F.array_distinct(T.words(F.col("query"), 3)).alias("terms")), "query_id").join(articles.withColumnRenamed("doc_id", "id"), "id")
    match = S.query_match(F.col("terms"), F.col("query"), F.col("title"), F.col("lead"), F.col("source"), F.col("text"))
    total = S.final_score(F.col("rerank"), F.col("norm"), F.col("trust"), F.col("grade"), F.col("freshness"), F.col("zone"), F.col("value"), match)
    rows = rows.withColumn("total", F.round(total, 4))
    best = R.ranked(rows, ["query_id"], [F.desc("total"), F.col("id")], None if clusters is not None else limit)
    if clusters is not None:
        best = one_a_cluster(best.withColumnsRenamed({"id": "news_id", "score": "_retrieval", "total": "score"}), clusters, limit).withColumnsRenamed({"score": "total", "_retrieval": "score", "news_id": "id"})
    none = F.array().cast("array<string>")
    why = T.explanation(F.col("mode"), F.col("expansions"), F.col("zone"), none, none, none, F.col("grade") > 5, F.col("source"), F.col("grade"))
    return best.select("query_id", F.col("id").alias("news_id"), F.col("total").alias("score"), F.round("norm", 6).alias("retrieval"), "rank", T.snippet(F.col("text"), F.col("terms")).alias("snippet"), why.alias("explanation"))


def for_user(results: DataFrame, topics: DataFrame, sources: DataFrame, seen: DataFrame, recent: DataFrame) -> DataFrame:
    """(user_id, news_id, base, score, reasons, rank): results (user_id, news_id, source_id, topic, base, grade, uncertain) scored by the user's profile.

    topics (user_id, topic, weight), sources (user_id, source_id, preference, implicit), seen (user_id, news_id), recent topics (user_id, topic): tables joined by key, a row each.
    """
    rows = results.join(topics.withColumnRenamed("weight", "topic_weight"), ["user_id", "topic"], "left").join(sources, ["user_id", "source_id"], "left")
    rows = rows.join(seen.select("user_id", "news_id").distinct().withColumn("was_seen", F.lit(True)), ["user_id", "news_id"], "left").join(recent.select("user_id", "topic").distinct().withColumn("is_recent", F.lit(True)), ["user_id", "topic"], "left")
    affinity = F.greatest(F.lit(0.0), F.coalesce("topic_weight", F.lit(0.5)) - 0.5)
    source = S.source_affinity(F.coalesce("preference", F.lit("neutral")), F.coalesce("implicit", F.lit(0.5)))
    was, now, blocked = F.coalesce("was_seen", F.lit(False)), F.coalesce("is_recent", F.lit(False)), F.coalesce(F.col("preference") == "blocked", F.lit(False))
    score = S.personal_score(F.col("base"), affinity, F.lit(0.0), source, now.cast("double"), F.lit(0.0), was, F.col("grade"), F.col("uncertain"), blocked)
    reasons = F.concat_ws(",", F.when(affinity > 0, "topic"), F.when(blocked, "source_blocked").when(source > 0, "source_preferred").when(source < 0, "source_disliked"), F.when(now, "session"), F.when(was, "seen_penalty_applied"), F.when(F.col("grade") >= 5, F.concat(F.lit("trust_guard: grade="), F.col("grade").cast("string"))).when(F.col("uncertain"), "trust_guard: uncertain"))
    made = rows.select("user_id", "news_id", "source_id", "topic", F.round("base", 4).alias("base"), F.round(score, 4).alias("score"), reasons.alias("reasons"))
    return R.ranked(made, ["user_id"], [F.desc("score"), F.col("news_id")])


def personal(results: DataFrame, slider: float, **profile: DataFrame) -> DataFrame:
    """(user_id, position, news_id): results ranked for each user, then spread over sources and topics by the slider."""
    own = for_user(results, **profile).select(F.col("user_id").alias("key"), "rank", "news_id", "source_id", F.array("topic").alias("topics"), "score")
    return P.diversified(own, slider).select(F.col("key").alias("user_id"), "position", "news_id")
