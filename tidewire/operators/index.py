"""A full-text index as tables, and top-k search that sums only what can matter.

postings (term, block, n, docs, shares): the n documents of a term by what of its weight they get, the largest first, in blocks of BLOCK. tops (term, idf, most, n): a term's weight,
the most that it adds to a document's score, and how many documents have it. heads (term, doc_id, share): its HEAD largest. All are written once and read by many searches; a term's blocks lie
together. Texts are counted by batches, and a batch's list of a term is a row: postings are shuffled once, as such lists, and put in order by arrays.

A search has two steps. Heads alone give scores that the true ones reach or pass, so the k-th of them is a bound that no result falls below. Then the postings of the queries' terms
are multiplied with the queries where their document lies, and only sums that reach the bound, and the best so far, leave their task.

``marked`` and ``candidates`` say what of an index leads to results: a query's terms are ordered by the most that they add, and the first ones that don't add up to the bound can't make
a result without another term, so only documents of the other terms, which are the rarer ones, are candidates; those whose sum so far and the most of the first ones don't reach the bound go.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators import corpus as C
from tidewire.operators.retrieval import ranked
from tidewire.sources.store import settle

#: Best postings of a term that are kept apart.
HEAD = 64
#: Postings of a block.
BLOCK = 4096
#: What sums of doubles in another order, and ties, may be below the bound.
SLACK = 1e-8


class Index(NamedTuple):
    postings: DataFrame
    tops: DataFrame
    heads: DataFrame


def built(docs: DataFrame, scratch, least: int = 3, head: int = HEAD) -> Index:
    """The index of documents (doc_id, text) with the weights of ``corpus.bm25``."""
    posts = scratch.put(C.term_postings(docs, least))
    # each token is counted in one posting, so the texts aren't read again for their mean size
    known = posts.agg(F.sum("total").alias("size")).crossJoin(docs.agg(F.count("text").alias("texts"), F.count("*").alias("docs"))).first()
    mean = (known["size"] or 0) / max(1, known["texts"])
    kinds = f"term string, block int, n long, {posts.select('docs').schema.simpleString()[7:-1].replace(':', ' ', 1)}, shares array<double>"
    rows = scratch.put(posts.select("term", "docs", "tfs", "sizes").repartition("term").sortWithinPartitions("term").mapInArrow(_blocks(mean), kinds))
    scratch.drop(posts)
    idf, first = C.bm25_idf(F.col("n"), F.lit(known["docs"])), rows.where("block = 0")
    tops = scratch.put(first.select("term", idf.alias("idf"), (idf * F.get("shares", F.lit(0))).alias("most"), "n"))
    heads = scratch.put(first.select("term", F.slice("docs", 1, head).alias("docs"), F.slice("shares", 1, head).alias("shares")))
    return Index(rows, tops, opened(heads))


def opened(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, share) of blocks (term, docs, shares)."""
    return blocks.select("term", F.explode(F.arrays_zip("docs", "shares")).alias("p")).select("term", F.col("p.docs").alias("doc_id"), F.col("p.shares").alias("share"))


def postings_of(index: Index, terms: DataFrame) -> DataFrame:
    """(term, doc_id, share) of the terms (term); blocks of others aren't opened."""
    return opened(index.postings.join(terms.select("term").distinct(), "term", "left_semi"))


def _blocks(mean: float):
    """A function of batches (term, docs, tfs, sizes), a term's rows together, that gives the blocks of postings."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            # a term may go on in the next batch
            parts = [*([rest] if rest is not None else []), *([pa.table(batch)] if batch is not None else [])]
            if not sum(p.num_rows for p in parts):
                continue
            table = pa.concat_tables(parts).combine_chunks()
            runs = pc.run_end_encode(table["term"].chunk(0))
            ends = runs.run_ends.to_numpy()
            ends = ends[:-1] if batch is not None else ends
            done = int(ends[-1]) if len(ends) else 0
            rest = table.slice(done)
            if not done:
                continue
            docs, tf, size = (table[c].chunk(0).slice(0, done).flatten() for c in ("docs", "tfs", "sizes"))
            term = np.repeat(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), pc.list_value_length(table["docs"].chunk(0).slice(0, done)).to_numpy(zero_copy_only=False))
            share = C.bm25_share(tf.to_numpy(zero_copy_only=False), size.to_numpy(zero_copy_only=False), mean)
            order = np.lexsort((-share, term))
            n = np.bincount(term, minlength=len(ends))
            place = np.arange(len(term)) - np.repeat(np.cumsum(n) - n, n)
            starts = np.flatnonzero(place % BLOCK == 0)
            cuts, own = pa.array(np.append(starts, len(term)), pa.int32()), term[starts]
            lists = (pa.ListArray.from_arrays(cuts, x) for x in (docs.take(pa.array(order)), pa.array(share[order])))
            yield pa.RecordBatch.from_arrays([runs.values.take(pa.array(own)), pa.array(place[starts] // BLOCK, pa.int32()), pa.array(n[own], pa.int64()), *lists], ["term", "block", "n", "docs", "shares"])

    return found


def bounds(index: Index, asked: DataFrame, limit: int) -> DataFrame:
    """(query_id, bound): the score that the ``limit`` best of a query reach, where heads tell. asked: (query_id, term, idf)."""
    sums = index.heads.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("share")).alias("s"))
    return ranked(sums, ["query_id"], [F.desc("s"), F.col("doc_id")], limit).where(F.col("rank") == limit).select("query_id", F.col("s").alias("bound"))


def marked(index: Index, terms: DataFrame, limit: int) -> DataFrame:
    """(query_id, term, idf, n, leads, spare, bound) of each query's known terms (query_id, term): whether a term leads to candidates, what all that don't can add at most, and the score that the ``limit`` best reach (null: none is known)."""
    known = index.tops.join(terms, "term")
    own = Window.partitionBy("query_id")
    upto = F.sum("most").over(own.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    leads = F.col("bound").isNull() | (F.col("upto") >= F.col("bound") - SLACK)
    rows = known.withColumn("upto", upto).join(bounds(index, known, limit), "query_id", "left").withColumn("leads", leads)
    return rows.select("query_id", "term", "idf", "n", "leads", F.coalesce(F.max(F.when(~F.col("leads"), F.col("upto"))).over(own), F.lit(0.0)).alias("spare"), "bound")


def candidates(index: Index, found: DataFrame) -> DataFrame:
    """(query_id, doc_id, w): documents that can be results, by the sums of the terms that lead to them. found: ``marked``."""
    led = found.where("leads").select("query_id", "term", "idf")
    sums = postings_of(index, led).join(led, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("share")).alias("w"))
    rule = found.groupBy("query_id").agg(F.max("spare").alias("spare"), F.max("bound").alias("bound"))
    return sums.join(rule, "query_id").where(F.col("bound").isNull() | (F.col("w") + F.col("spare") >= F.col("bound") - SLACK)).select("query_id", "doc_id", "w")


def search(index: Index, queries: DataFrame, limit: int, published: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(query_id, doc_id, score, rank) of queries (query_id, text), best first. Ties to nine digits go by id, or with ``published`` (doc_id, published_at) by the newest, those without a date last, then by the largest id."""
    asked = settle(index.tops.join(C.query_terms(queries, least), "term").select("query_id", "term", "idf"))
    posts = postings_of(index, asked).select("doc_id", "term", F.col("share").alias("x"))
    score = C.products(posts, asked.withColumnRenamed("idf", "weight"), "term", limit, bounds(index, asked, limit))
    value = F.desc(F.round("score", 9))
    if published is None:
        return ranked(score, ["query_id"], [value, F.col("doc_id")], limit)
    # ties at the list's end are decided by dates, so all of them meet theirs
    near = score.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy(value))).where(F.col("_r") <= limit)
    dated = near.join(published.select("doc_id", "published_at"), "doc_id", "left")
    return ranked(dated, ["query_id"], [value, F.desc_nulls_last("published_at"), F.desc("doc_id")], limit).select("query_id", "doc_id", "score", "rank")
