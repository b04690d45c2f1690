"""Dense, sparse and fused retrieval, ranking, and ranking metrics. Queries come in batches: (query_id, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import scores as S
from tidewire.sources.store import settle


def ranked(rows: DataFrame, keys: list[str], order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered within keys; with a limit the rest go before they are shuffled (window group limit)."""
    made = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return made.where(F.col(name) <= limit) if limit else made


#: Query vectors are sent to all tasks up to so many numbers (rows times dimensions); above, the join is dealt out in blocks.
BROADCAST_NUMBERS = 4_000_000
#: Vectors and queries that are multiplied at a time.
TILE = 1024
#: What a cosine that is as good after rounding to nine digits may lie below, with room for sums in another order.
SLACK = 2e-9


def _numbers(vector: Column) -> Column:
    """Whether a vector has numbers alone, so that its cosines are numbers."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > 1e150)), F.lit(False))


def _tops(ids: pa.Array, vectors: pa.Array, size: int, limit: int):
    """A function of batches (id, vector) that gives those (query_id, id, score) that can be among a query's ``limit`` nearest of its task; scores as ``scores.cosine`` has them, bit for bit."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        def matrix(lists: pa.Array) -> np.ndarray:
            return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)

        def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            made = np.zeros(len(a))
            for k in range(size):  # in order
                made += a[:, k] * b[:, k]
            return made

        def unit(m: np.ndarray, norm: np.ndarray) -> np.ndarray:
            return np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)

        asked = matrix(vectors)
        long = np.sqrt(dot(asked, asked))
        q, best = unit(asked, long), np.full((len(asked), limit), -np.inf)
        for b in batches:
            for at in range(0, b.num_rows, TILE):
                part = b.slice(at, TILE)
                part = part.take(pc.sort_indices(part["id"], null_placement="at_start"))  # so places are in the order of ids
                own = matrix(part["vector"])
                norm = np.sqrt(dot(own, own))
                v = unit(own, norm)
                for low in range(0, len(q), TILE):
                    score = q[low : low + TILE] @ v.T
                    rows = np.flatnonzero(score.max(1) >= best[low : low + TILE, 0] - SLACK)
                    if not len(rows):
                        continue
                    score, rows = score[rows], rows + low
                    both = np.concatenate([best[rows], score], 1)
                    best[rows] = np.sort(np.partition(both, both.shape[1] - limit, 1)[:, -limit:], 1)
                    i, j = np.nonzero(score >= best[rows, :1] - SLACK)
                    i = rows[i]
                    scale = norm[j] * long[i]
                    exact = np.divide(dot(own[j], asked[i]), scale, out=np.zeros(len(i)), where=scale > 0)
                    # of copies, whose scores are one value, the first by id are enough
                    order = np.lexsort((j, exact, i))
                    i, j, exact = i[order], j[order], exact[order]
                    new = np.r_[True, (i[1:] != i[:-1]) | (exact[1:] != exact[:-1])]
                    place = np.arange(len(i))
                    few = place - np.maximum.accumulate(np.where(new, place, 0)) < limit
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[few])), part["id"].take(pa.array(j[few])), pa.array(exact[few])], ["query_id", "id", "score"])

    return near


def knn(vectors: DataFrame, queries: DataFrame, limit: int, where: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): nearest vectors (id, vector) by cosine, the filter applied before ranking.

    A stated query set against all rows, in blocks of at most ``BROADCAST_NUMBERS`` numbers, one pass over the vectors each. Matrices
    of vectors and queries are multiplied, and a task gives only pairs that can be among a query's nearest of its rows (with slack for
    rounding), with cosines summed in order. Vectors of another size than most queries', or not of numbers alone, go through the plain expression. No query's candidates meet in one task before they are cut.
    """
    base = vectors if where is None else vectors.where(where)
    order = [F.desc(F.round("score", 9)), F.col("id")]
    sizes = queries.where(_numbers(F.col("vector")) & (F.size("vector") > 0)).groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    size, rows = sizes or (0, 0)
    usual = _numbers(F.col("vector")) & (F.size("vector") == size)
    odd = ~usual | F.col("vector").isNull()
    asked = lambda own: own.select("query_id", F.col("vector").alias("query"))
    parts = []
    for pairs in (base.crossJoin(asked(queries.where(odd))), base.where(odd).crossJoin(asked(queries.where(usual)))):
        scored = pairs.select("query_id", "id", S.cosine(F.col("vector"), F.col("query")).alias("score"), F.spark_partition_id().alias("_part"))
        parts.append(ranked(scored, ["query_id", "_part"], order, limit).drop("_part", "rank"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    whole = F.col("vector").cast("array<double>").alias("vector")
    blocks = -(-rows * size // BROADCAST_NUMBERS)
    for b in range(blocks):
        held = queries.where(usual & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).select("query_id", whole).toArrow().combine_chunks()
        if held.num_rows:
            ids, own = (held[c].combine_chunks() for c in ("query_id", "vector"))
            parts.append(base.where(usual).select("id", whole).mapInArrow(_tops(ids, own, size, limit), kinds))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return ranked(made, ["query_id"], order, limit)


def fused(lists: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): reciprocal-rank fusion of ranked lists (query_id, list, id, rank)."""
    score = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return ranked(score, ["query_id"], [F.desc(F.round("score", 12)), F.col("id")], limit)


def merged(lists: DataFrame) -> DataFrame:
    """One row an id of several lists (list, position, id, ...): the first occurrence wins."""
    return ranked(lists, ["query_id", "id"], [F.col("list"), F.col("position")], 1, "_rn").drop("_rn")


def best_per_article(hits: DataFrame) -> DataFrame:
    """The best-scored chunk of each article, the first on ties (query_id, news_id, seq, score)."""
    return ranked(hits, ["query_id", "news_id"], [F.desc("score"), F.col("seq")], 1, "_rn").drop("_rn")


def normalised(hits: DataFrame) -> DataFrame:
    """Scores over the largest of their query."""
    return hits.withColumn("norm", F.try_divide(F.col("score"), F.max("score").over(Window.partitionBy("query_id"))))


def rerank_split(hits: DataFrame, most: int) -> DataFrame:
    """Which hits go to the reranker: all if there are at most ``most``; else the best of each article, ``most`` of them. The others keep 0.5."""
    order = [F.desc("score"), F.col("seq")]
    rows = hits.repartition("query_id").withColumn("_first", F.row_number().over(Window.partitionBy("query_id", "news_id").orderBy(*order)) == 1)
    place = F.row_number().over(Window.partitionBy("query_id", "_first").orderBy(*order))
    # all of a query's hits, in the order of their places: so the count needs no sort of its own
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("query_id").orderBy("_first", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("to_rerank", (F.col("_n") <= most) | (F.col("_first") & (place <= most))).drop("_n", "_first")


def filtered(chunks: DataFrame, language=None, start=None, end=None, sources=None, topics=None, zone=None, grade=None, grade_max=None, urgency=None, kind=None, cluster=None) -> DataFrame:
    """Conjunction of the payload filters that are set; an exact grade wins over a largest."""
    rules = []
    if language is not None:
        rules.append(F.col("language") == language)
    if start is not None:
        rules.append(F.col("published_at") >= F.lit(start))
    if end is not None:
        rules.append(F.col("published_at") <= F.lit(end))
    if sources is not None:
        rules.append(F.col("source_id").isin(*sources))
    if topics is not None:
        rules.append(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))
    if zone is not None:
        rules.append(F.col("zone") == zone)
    if grade is not None:
        rules.append(F.col("content_grade") == grade)
    elif grade_max is not None:
        rules.append(F.col("content_grade") <= grade_max)
    for c, v in (("urgency", urgency), ("information_type", kind), ("event_cluster_id", cluster)):
        if v is not None:
            rules.append(F.col(c) == v)
    for r in rules:
        chunks = chunks.where(r)
    return chunks


def ir_metrics(judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision_at_k, reciprocal_rank, ndcg, diversity) from (query_id, rank, relevance, source), which are written once, for they are read twice."""
    judged = settle(judged)
    top = judged.where(F.col("rank") <= k)
    gain = (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1)
    ideal = ranked(judged, ["query_id"], [F.desc("relevance"), F.col("rank")], k, "ideal_rank").groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("ideal_rank") + 1)).alias("ideal"))
    made = top.groupBy("query_id").agg((F.count_if(F.col("relevance") > 0) / F.lit(float(k))).alias("precision_at_k"), F.coalesce(1.0 / F.min(F.when(F.col("relevance") > 0, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), F.sum(gain).alias("dcg"), (F.countDistinct("source") / F.count("*")).alias("diversity"))
    return made.join(ideal, "query_id").select("query_id", "precision_at_k", "reciprocal_rank", F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"), "diversity")


def personal_metrics(judged: DataFrame, k: int = 10) -> DataFrame:
    """(scenario, hit_rate, mrr, blocked_exposure, coverage, seen_share) from (scenario, user_id, rank, news_id, relevant, blocked, seen, topic)."""
    top = judged.where(F.col("rank") <= k)
    users = top.groupBy("scenario", "user_id").agg(F.max(F.col("relevant").cast("int")).alias("hit"), F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    a = users.groupBy("scenario").agg(F.avg("hit").alias("hit_rate"), F.avg("rr").alias("mrr"))
    b = top.groupBy("scenario").agg((F.count_if("blocked") / F.count("*")).alias("blocked_exposure"), F.countDistinct("news_id").alias("coverage"), (F.count_if("seen") / F.count("*")).alias("seen_share"), F.countDistinct("topic").alias("topics"))
    return a.join(b, "scenario")
