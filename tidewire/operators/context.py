"""Contexts for answers: cluster representatives, token budgets, chunks, chats, citations and groundedness."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators.retrieval import ranked


def cluster_representatives(items: DataFrame, order: list[Column], supporting: int = 2) -> DataFrame:
    """The first item of each cluster (query_id, cluster, news_id) and up to ``supporting`` more. Items without a cluster stand alone."""
    key = F.coalesce(F.col("cluster").cast("string"), F.concat(F.lit("#"), F.col("news_id").cast("string")))
    made = ranked(items.withColumn("group", key), ["query_id", "group"], order, supporting + 1, "place")
    return made.withColumn("role", F.when(F.col("place") == 1, "representative").otherwise("supporting"))


def within_budget(docs: DataFrame, budget: int, overhead: Column) -> DataFrame:
    """Documents (query_id, rank, content) in rank order while their tokens fit; the first that doesn't is cut to what is left, and nothing follows it.

    Which document is first over the budget follows from one running sum.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = docs.withColumn("own", T.estimated_tokens(F.col("content")) + overhead).withColumn("upto", F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("over", F.sum((F.col("upto") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("upto") - F.col("own")) - overhead
    room = F.greatest(F.lit(1), left * 2 - 3).cast("int")
    trimmed = F.concat(F.rtrim(F.substring("content", F.lit(1), room)), F.lit("..."))
    return rows.where((F.col("over") == 0) | ((F.col("over") == 1) & (left > 0))).withColumn("trimmed", F.col("over") == 1).withColumn("content", F.when(F.col("over") == 1, trimmed).otherwise(F.col("content"))).drop("own", "upto", "over")


def chunk_windows(tokens: list[int], most: int = 420, overlap: int = 70) -> list[tuple[int, int]]:
    """[first, last) sentence windows of at most ``most`` tokens (one sentence at least), each reaching back at least ``overlap`` tokens.

    Both borders are places in the running sum of tokens: a window ends at the last sum within
    ``most`` of its start, and the next starts at the last sum that lies ``overlap`` before that end.
    """
    import numpy as np

    n, upto = len(tokens), np.concatenate([[0], np.cumsum(tokens)])
    place = np.arange(n)
    ends = np.maximum(place + 1, np.searchsorted(upto, upto[:-1] + most, "right") - 1)
    following = np.maximum(place + 1, np.searchsorted(upto, upto[ends] - overlap, "right") - 1) if n else place
    starts = [0] if n else []
    while starts and ends[starts[-1]] < n:
        starts.append(int(following[starts[-1]]))
    return [(a, int(ends[a])) for a in starts]


def sentence_chunks(docs: DataFrame, most: int = 420, overlap: int = 70) -> DataFrame:
    """(doc_id, chunk, start, end, tokens, text) of (doc_id, text): windows over sentences, with code point offsets. Texts without sentences give none."""
    import re

    split = re.compile(r"(?<=[.!?])\s+")

    def of(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                places, at = [], 0
                for m in [*split.finditer(text or ""), None]:
                    end = m.start() if m else len(text or "")
                    if (s := (text or "")[at:end]).strip():
                        places.append((at + len(s) - len(s.lstrip()), at + len(s.rstrip()), len(s.split())))
                    at = m.end() if m else end
                for k, (a, b) in enumerate(chunk_windows([n for _, _, n in places], most, overlap)):
                    start, end = places[a][0], places[b - 1][1]
                    rows.append((doc, k, start, end, sum(n for _, _, n in places[a:b]), text[start:end]))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "tokens", "text"])

    return docs.select("doc_id", "text").mapInPandas(of, "doc_id long, chunk int, start long, end long, tokens long, text string")


def chat_window(messages: DataFrame, turns: int) -> DataFrame:
    """The last 2 * turns messages of each session (session, seq, ...) in order, with the session's total."""
    rows = messages.withColumn("total", F.count("*").over(Window.partitionBy("session")))
    return ranked(rows, ["session"], [F.desc("seq")], 2 * turns, "_back").withColumn("position", F.row_number().over(Window.partitionBy("session").orderBy("seq")).cast("long")).drop("_back")


def summary_tail(messages: DataFrame, least: int = 12, tail: int = 6, cut: int = 200) -> DataFrame:
    """(session, summary): the last ``tail`` messages, cut, as JSON, of sessions that have ``least`` messages."""
    rows = chat_window(messages, tail // 2).where(F.col("total") >= least)
    return rows.groupBy("session").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "role", F.substring("text", 1, cut).alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("summary"))


def groundedness(claims: DataFrame, sources: DataFrame, ratio: float = 0.3, accept: float = 0.6, least: int = 4) -> DataFrame:
    """(answer_id, claims, supported, groundedness, acceptable): a claim (answer_id, claim_id, claim) is supported if its best source (answer_id, source_id, text) has at least ``ratio`` of its stemmed tokens."""
    tokens = lambda c: F.array_distinct(F.transform(T.words(c, least), T.stem))
    c = claims.select("answer_id", "claim_id", tokens(F.col("claim")).alias("tokens"))
    s = sources.select("answer_id", tokens(F.col("text")).alias("seen"))
    best = c.join(s, "answer_id", "left").groupBy("answer_id", "claim_id").agg(F.max(F.coalesce(F.try_divide(F.size(F.array_intersect("tokens", "seen")), F.size("tokens")), F.lit(0.0))).alias("share"))
    made = best.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(F.col("share") >= ratio).alias("supported"))
    return made.withColumn("groundedness", F.col("supported") / F.col("claims")).withColumn("acceptable", F.col("groundedness") >= accept)


def cited(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(answer_id, cited, unknown, valid): the numbers of [Doc n] marks against the allowed ones (answer_id, index). Valid: something is cited, and nothing unknown."""
    marks = answers.select("answer_id", F.coalesce(T.citations(F.col("answer")), F.array().cast("array<int>")).alias("marks"))
    ok = allowed.groupBy("answer_id").agg(F.collect_set(F.col("index").cast("int")).alias("allowed"))
    rows = marks.join(ok, "answer_id", "left").withColumn("unknown", F.size(F.array_except("marks", F.coalesce("allowed", F.array().cast("array<int>")))))
    return rows.select("answer_id", F.size("marks").alias("cited"), "unknown", ((F.size("marks") > 0) & (F.col("unknown") == 0)).alias("valid"))


def cited_names(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """(answer_id, source, valid): the sources that each answer (answer_id, answer) names, and whether they are among those it was given (answer_id, source)."""
    named = answers.select("answer_id", F.explode(T.cited_sources(F.col("answer"))).alias("source")).withColumn("key", T.source_key(F.col("source")))
    given = allowed.where("source <> ''").select("answer_id", T.source_key(F.col("source")).alias("key")).distinct().withColumn("_given", F.lit(True))
    return named.join(given, ["answer_id", "key"], "left").select("answer_id", "source", F.coalesce("_given", F.lit(False)).alias("valid"))
