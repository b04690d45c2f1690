"""Around an answer: which documents it used, whether it needs correction, which context to answer from. The language model is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.functions import text as T
from tidewire.operators.retrieval import ranked


def sources_used(used: DataFrame, items: DataFrame) -> DataFrame:
    """(answer_id, news_id, source, place): the different articles (news_id, source) of an answer's used documents (answer_id, index, news_id), in order of their first place."""
    first = used.where("news_id IS NOT NULL").groupBy("answer_id", "news_id").agg(F.min("index").alias("index"))
    return ranked(first.join(items.select("news_id", "source"), "news_id"), ["answer_id"], [F.col("index"), F.col("news_id")], None, "place").select("answer_id", "news_id", "source", "place")


def checked(answers: DataFrame, floor: float = 0.45) -> DataFrame:
    """Answers (cited, unsupported, groundedness, label, answer) with needs_correction and refused."""
    return answers.withColumn("needs_correction", S.needs_correction(F.col("cited"), F.col("unsupported"), F.col("groundedness"), floor)).withColumn("refused", T.is_refusal(F.col("answer")))


def better(first: DataFrame, second: DataFrame) -> DataFrame:
    """(answer_id, corrected): whether the corrected answer is strictly better; else the first one stays."""
    key = S.quality_key(F.col("cited"), F.col("unsupported"), F.col("groundedness"), F.col("label"))
    a, b = first.select("answer_id", key.alias("a")), second.select("answer_id", key.alias("b"))
    return a.join(b, "answer_id", "left").select("answer_id", F.coalesce(F.col("b") > F.col("a"), F.lit(False)).alias("corrected"))


def corrective(first: DataFrame, retried: DataFrame, queries: DataFrame, floor: float = 0.62) -> DataFrame:
    """(query_id, refined, should_retry, used_retry, reason): contexts (query_id, quality, documents) below ``floor`` are retrieved again with the refined query, and the better one is kept."""
    rows = first.select("query_id", F.col("quality").alias("q1")).join(retried.select("query_id", F.col("quality").alias("q2"), F.col("documents").alias("n2")), "query_id", "left").join(queries, "query_id", "left")
    retry = F.col("q1") < floor
    used = F.coalesce(retry & (F.col("q2") > F.col("q1")) & (F.col("n2") > 0), F.lit(False))
    reason = F.when(~retry, "initial_context_good_enough").when(used, "retry_improved_context").otherwise("retry_did_not_improve_context")
    return rows.select("query_id", F.when(retry, T.refined(F.col("query"))).alias("refined"), retry.alias("should_retry"), used.alias("used_retry"), reason.alias("reason"))


def relevant(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents (query_id, news_id, text) that share a token with their query (query_id, query); all, if it has none."""
    q = queries.select("query_id", F.array_distinct(T.words(F.col("query"))).alias("terms"))
    return documents.join(q, "query_id").where((F.size("terms") == 0) | F.arrays_overlap("terms", T.words(F.col("text")))).drop("terms")


def self_checked(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, relevant, retrieve, reason): whether a query's documents will do, or others are to be retrieved; greetings need none."""
    n = relevant(queries, documents).groupBy("query_id").agg(F.count("*").alias("relevant"))
    rows = queries.join(n, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    small = T.is_smalltalk(F.col("query"))
    retrieve = (F.col("relevant") == 0) & ~small
    reason = F.when(retrieve, "retrieval_triggered_for_missing_relevant_context").when(small, "no_retrieve_smalltalk_like_query").otherwise("existing_context_relevant")
    return rows.select("query_id", "relevant", retrieve.alias("retrieve"), reason.alias("reason"))
