"""Corpus statistics and lexical retrieval: vocabulary, collocations, weights, inverted index, spelling, expansion.

Documents are (doc_id, text). Counts combine on the map side before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from hashlib import sha256
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.sources.store import lean, settle


def terms(docs: DataFrame, least: int = 1, keep=None) -> DataFrame:
    """(doc_id, term) for each token of at least ``least`` letters, once an occurrence."""
    made = docs.select("doc_id", F.explode(T.words(F.col("text"), least)).alias("term"))
    return made if keep is None else made.where(keep(F.col("term")))


def _after(count: Column, rule: Column) -> Column:
    """The rule where the count's condition holds. A plain filter on the grouping key would be pushed below the aggregation and run once an occurrence."""
    return F.when(count, rule).otherwise(False)


def term_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    """(term, doc_frequency, collection_frequency) of all terms. Occurrences are summed by (term, document) first, so a common term reaches its final task as one row a partition."""
    own = terms(docs, least).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return own.groupBy("term").agg(F.count("*").alias("doc_frequency"), F.sum("n").alias("collection_frequency"))


def vocabulary_of(counts: DataFrame, floor: int = 3) -> DataFrame:
    """The informative terms with at least ``floor`` occurrences."""
    return counts.where(_after(F.col("collection_frequency") >= floor, T.is_informative_token(F.col("term"))))


def vocabulary(docs: DataFrame, least: int = 2, floor: int = 3) -> DataFrame:
    """(term, doc_frequency, collection_frequency) of informative terms with at least ``floor`` occurrences."""
    return vocabulary_of(term_counts(docs, least), floor)


def pairs(docs: DataFrame, least: int = 2) -> DataFrame:
    """(a, b) for neighbouring tokens of a sentence."""
    sentences = docs.select(F.explode(F.split("text", r"[.!?]\s")).alias("text"))  # what else stands between them is no part of a token
    both = sentences.select(T.words(F.col("text"), least).alias("w")).where("size(w) > 1").select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("p"))
    return both.select("p.a", "p.b")


def useful_pair(a: Column, b: Column) -> Column:
    """Whether two tokens make a pair that counts."""
    plain = lambda t: F.replace(t, F.lit("ё"), F.lit("е"))
    return (plain(a) != plain(b)) & T.is_informative_token(a) & T.is_informative_token(b)


def collocations_of(single: DataFrame, paired: DataFrame, frequency: int = 5, pmi: float = 3.0) -> DataFrame:
    """(term_a, term_b, pmi_score, frequency) from the counts of informative terms (term, n) and of their neighbourhoods (a, b, n): those seen together more than chance has it (natural logarithm).

    Pairs below ``frequency`` count in the total alone: they fall into one row a task before anything is joined or written.
    """
    often = F.col("n") >= frequency
    cut = settle(paired.groupBy(F.when(often, F.col("a")).alias("a"), F.when(often, F.col("b")).alias("b")).agg(F.sum("n").alias("n")))
    total = cut.agg(F.sum("n").alias("pairs")).crossJoin(single.agg(F.sum("n").alias("singles")))  # one row
    a, b = (single.select(F.col("term").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    rows = cut.where("a IS NOT NULL").join(a, "a").join(b, "b").crossJoin(F.broadcast(total))
    score = F.ln((F.col("n") / F.col("pairs")) / ((F.col("n_a") / F.col("singles")) * (F.col("n_b") / F.col("singles"))))
    return rows.withColumn("pmi_score", score).where(F.col("pmi_score") >= pmi).select(F.col("a").alias("term_a"), F.col("b").alias("term_b"), F.round("pmi_score", 4).alias("pmi_score"), F.col("n").alias("frequency"))


def collocations(docs: DataFrame, least: int = 2, frequency: int = 5, pmi: float = 3.0) -> DataFrame:
    """``collocations_of`` the documents. The rule on terms runs once a distinct term. The rule on pairs runs once an occurrence: it costs less than to shuffle those that it leaves out."""
    single = settle(terms(docs, least).groupBy("term").agg(F.count("*").alias("n")).where(_after(F.col("n") > 0, T.is_informative_token(F.col("term")))))
    paired = pairs(docs, least).where(useful_pair(F.col("a"), F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    return collocations_of(single, paired, frequency, pmi)


def _dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in lower case, dealt out by document and each document's rows together. Texts are much work for few bytes: the number of tasks is stated, else they would be merged into few."""
    lean(docs.sparkSession)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("doc_id", F.lower("text").alias("text")).repartition(tasks, "doc_id").sortWithinPartitions("doc_id")


class Counts(NamedTuple):
    """Terms of a batch's documents: numbers of documents (``docs``) and of terms (``terms``), how often the term stands there, and how many tokens of so many letters each document has."""

    docs: pa.Array
    terms: pa.Array
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    sizes: list[np.ndarray]


def _counted(batches: Iterator[pa.RecordBatch], least: tuple[int, ...]) -> Iterator[Counts]:
    """The counts of batches (doc_id, text in lower case), a document's rows together: all tokens of a batch are found and counted at once, by arrays."""
    rest = None
    for b in chain(batches, [None]):
        # a document may go on in the next batch
        parts = [*([rest] if rest is not None else []), *([pa.table(b)] if b is not None else [])]
        if not sum(p.num_rows for p in parts):
            continue
        table = pa.concat_tables(parts).combine_chunks()
        runs = pc.run_end_encode(table["doc_id"].chunk(0))
        ends = runs.run_ends.to_numpy()
        ends = ends[:-1] if b is not None else ends
        done = int(ends[-1]) if len(ends) else 0
        rest = table.slice(done)
        if not done:
            continue
        words = pc.split_pattern_regex(table["text"].chunk(0).slice(0, done), r"[^\p{L}\p{N}]+")
        held = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))  # each row's document
        doc = np.repeat(held, pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        words = words.flatten()
        letters = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        sizes = [np.bincount(doc[letters >= n], minlength=len(ends)) for n in least]
        keep = letters >= min(least)
        coded = words.filter(pa.array(keep)).dictionary_encode()
        key, tf = np.unique(doc[keep] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        doc, term = np.divmod(key, max(1, len(coded.dictionary)))
        yield Counts(runs.values.slice(0, len(ends)), coded.dictionary, doc, term, tf, sizes)


def postings(docs: DataFrame, least: tuple[int, ...] = (2,), wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, size_2, ..., tf): a document's terms with their counts, and for each of ``least`` how many of its tokens have so many letters.

    One pass over the texts serves all weights. wanted: the terms (term) that are asked for.
    Texts are dealt out by document, so its terms are counted where it lies: texts are shuffled once, postings never.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _counted(batches, least):
            yield pa.RecordBatch.from_arrays([c.docs.take(pa.array(c.doc)), c.terms.take(pa.array(c.term)), *(pa.array(n[c.doc], pa.int32()) for n in c.sizes), pa.array(c.tf, pa.int64())], names)

    names = ["doc_id", "term", *(f"size_{n}" for n in least), "tf"]
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, {', '.join(f'size_{n} int' for n in least)}, tf long"
    made = _dealt(docs).mapInArrow(found, kinds)
    return made if wanted is None else made.join(wanted.select("term").distinct(), "term", "left_semi")


def term_postings(docs: DataFrame, least: int) -> DataFrame:
    """(term, total, docs, tfs, sizes): the documents of a batch that have a term, how often each has it and how many tokens it has; total is the sum of tfs. A row a batch and term."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _counted(batches, (least,)):
            order = np.argsort(c.term, kind="stable")
            ends = pa.array(np.searchsorted(c.term[order], np.arange(len(c.terms) + 1)), pa.int32())
            lists = (c.docs.take(pa.array(c.doc[order])), pa.array(c.tf[order], pa.int64()), pa.array(c.sizes[0][c.doc[order]], pa.int32()))
            total = pa.array(np.bincount(c.term, c.tf, len(c.terms)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([c.terms, total, *(pa.ListArray.from_arrays(ends, x) for x in lists)], ["term", "total", "docs", "tfs", "sizes"])

    return _dealt(docs).mapInArrow(found, f"term string, total long, docs array<{docs.schema['doc_id'].dataType.simpleString()}>, tfs array<long>, sizes array<int>")


def tfidf(docs: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, term, weight): share of the document's tokens times ln(documents / document frequency)."""
    tf = settle(postings(docs, (least,)))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("docs"))
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select("doc_id", "term", (F.col("tf") / F.col(f"size_{least}") * F.ln(F.col("docs") / F.col("df"))).alias("weight"))


#: Commonest terms whose numbers of documents every task has; the documents of others are looked up by a join.
KNOWN = 250_000


def term_lists(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, size, terms, tfs): one row a document, its terms with their counts and how many tokens it has."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _counted(batches, (least,)):
            ends = pa.array(np.searchsorted(c.doc, np.arange(len(c.docs) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([c.docs, pa.array(c.sizes[0], pa.int32()), pa.ListArray.from_arrays(ends, c.terms.take(pa.array(c.term))), pa.ListArray.from_arrays(ends, pa.array(c.tf, pa.int64()))], ["doc_id", "size", "terms", "tfs"])

    return _dealt(docs).mapInArrow(found, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size int, terms array<string>, tfs array<long>")


def keywords(docs: DataFrame, count: int = 8, least: int = 4) -> DataFrame:
    """The ``count`` terms of most tf-idf weight by document, ties by term.

    Every task knows the KNOWN commonest terms, and of all others between which bounds their weights lie: only terms that can be among a document's best meet
    their number of documents by a join.
    """
    spark = docs.sparkSession
    lists = settle(term_lists(docs, least))
    df = settle(lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    often = sorted(df.groupBy("df").agg(F.count("*").alias("terms")).collect(), reverse=True)  # a row for each number of documents
    cut = next((r["df"] + 1 for r, upto in zip(often, accumulate(r["terms"] for r in often), strict=True) if upto > KNOWN), 1)
    known, n = df.where(F.col("df") >= cut).toArrow().combine_chunks(), docs.count()
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size int, term string, tf long"
    some = lists.mapInArrow(_promising(known["term"].combine_chunks(), known["df"].to_numpy(), cut, n, count), kinds)
    rows = some.join(df, "term").select("doc_id", "term", (F.col("tf") / F.col("size") * F.ln(F.lit(n) / F.col("df"))).alias("weight"))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "term")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= count)


def _promising(terms: pa.Array, df: np.ndarray, cut: int, n: int, count: int):
    """A function of batches (doc_id, size, terms, tfs) that gives (doc_id, size, term, tf) of the terms that can be among a document's ``count`` best: known ones (terms, df), and others, which fewer than ``cut`` of the n documents have."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["terms"]
            number = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            words, tf = lists.flatten(), b["tfs"].flatten()
            doc, first = np.repeat(np.arange(len(lists)), number), np.cumsum(number) - number
            at = pc.fill_null(pc.index_in(words, terms), -1).to_numpy(zero_copy_only=False)
            share = tf.to_numpy(zero_copy_only=False) / b["size"].to_numpy(zero_copy_only=False)[doc]
            idf = np.log(n / np.append(df, max(1, cut - 1)))
            low = share * idf[at]
            high = np.where(at >= 0, low, share * np.log(n))
            order = np.lexsort((-low, doc))
            bound = np.full(len(lists), -np.inf)
            bound[number >= count] = low[order[(first + count - 1)[number >= count]]]
            keep = np.flatnonzero(high >= bound[doc] - SLACK)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(doc[keep])), b["size"].take(pa.array(doc[keep])), words.take(pa.array(keep)), tf.take(pa.array(keep))], ["doc_id", "size", "term", "tf"])

    return found


def sparse_vectors(docs: DataFrame, least: int = 2, digits: int = 8) -> DataFrame:
    """(doc_id, idx, val): token shares summed by hashed index. A term is hashed once a batch, where its documents lie."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _counted(batches, (least,)):
            hashed = np.array([int(sha256(w.encode()).hexdigest()[:digits], 16) for w in c.terms.to_pylist()], np.int64)
            idx, code = np.unique(hashed, return_inverse=True)
            key, place = np.unique(c.doc * max(1, len(idx)) + code[c.term], return_inverse=True)
            doc, code = np.divmod(key, max(1, len(idx)))
            val = rounded(np.bincount(place, c.tf / c.sizes[0][c.doc], len(key)), 6)
            yield pa.RecordBatch.from_arrays([c.docs.take(pa.array(doc)), pa.array(idx[code]), pa.array(val)], ["doc_id", "idx", "val"])

    return _dealt(docs).mapInArrow(found, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, idx long, val double")


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Shares rounded as ``round`` of Spark does: halves of the shortest decimal go up. Only what lies near a half is looked at by itself."""
    scaled = values * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def sparse_dot(index: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the documents with the largest dot products, by joining posting lists."""
    q = queries.select("query_id", "idx", F.col("val").alias("weight"))
    score = index.join(q, "idx").groupBy("query_id", "doc_id").agg(F.sum(F.col("val") * F.col("weight")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return score.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def query_terms(queries: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, term): a query's distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("text"), least))).alias("term"))


def bm25_idf(df: Column, docs: Column) -> Column:
    """What a term weighs that stands in ``df`` of ``docs`` documents."""
    return F.ln(1 + (docs - df + 0.5) / (df + 0.5))


def bm25_share(tf: Column, size: Column, mean: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """What of it a document gets that has the term ``tf`` times."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


def bm25_weights(posts: DataFrame, stats: DataFrame, k1: float = 1.2, b: float = 0.75, least: int = 3) -> DataFrame:
    """(term, doc_id, w) of postings; stats: one row (mean, docs) of the whole corpus."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    rows = posts.join(df, "term").crossJoin(F.broadcast(stats))
    return rows.select("term", "doc_id", (bm25_idf(F.col("df"), F.col("docs")) * bm25_share(F.col("tf"), F.col(f"size_{least}"), F.col("mean"), k1, b)).alias("w"))


def corpus_stats(docs: DataFrame, least: int = 3) -> DataFrame:
    return docs.select(F.size(T.words(F.col("text"), least)).alias("size")).agg(F.avg("size").alias("mean"), F.count("*").alias("docs"))


def by_document(posts: DataFrame) -> DataFrame:
    """The postings, each document's in one task: sums by query and document need no further shuffle."""
    return posts.repartition(int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def best_documents(sums: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``limit`` best of (query_id, doc_id, score); ties to nine digits by id. Each task gives its own best alone."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return sums.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


#: Numbers (keys times queries) up to which queries are a matrix that each task has; above, rows are joined.
MATRIX = 4_000_000
#: Documents whose scores are compared at a time.
ROWS = 512
#: What a score that is as good after rounding to nine digits may lie below, with room for sums in another order.
SLACK = 2e-9


def best_products(posts: DataFrame, asked: DataFrame, key: str, limit: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the best sums of x * weight over the keys that a document (doc_id, key, x) shares with a query (query_id, key, weight > 0)."""
    return best_documents(products(posts, asked, key, limit), limit)


def products(posts: DataFrame, asked: DataFrame, key: str, limit: int, bounds: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): sums as for ``best_products``, all that can be among a query's ``limit`` best to nine digits, with all ties. bounds (query_id, bound): what the ``limit`` best reach, where known.

    Documents are dealt out whole. Where queries make a small matrix (their numbers are counted), a task multiplies each document with it and gives only what can be
    among a query's best of its documents; no pair of a query and a document is a row before that. More queries are joined.
    """
    size = asked.agg(F.countDistinct(key).alias("keys"), F.countDistinct("query_id").alias("queries")).first()
    if size["keys"] * size["queries"] > MATRIX:
        return by_document(posts).join(asked, key).groupBy("query_id", "doc_id").agg(F.sum(F.col("x") * F.col("weight")).alias("score"))
    held = asked.where(F.col(key).isNotNull()).select("query_id", key, "weight").toArrow().combine_chunks()
    queries, keys = (held[c].combine_chunks().dictionary_encode() if held.num_rows else pa.array([], held.schema.field(c).type).dictionary_encode() for c in ("query_id", key))
    numbers = posts.sparkSession.createDataFrame(pa.table({key: keys.dictionary, "_k": pa.array(range(len(keys.dictionary)), pa.int32())}))
    rows = by_document(posts.join(F.broadcast(numbers), key).select("doc_id", "_k", "x")).sortWithinPartitions("doc_id", "_k")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, doc_id {posts.schema['doc_id'].dataType.simpleString()}, score double"
    lean(posts.sparkSession)
    known = {} if bounds is None else {r["query_id"]: r["bound"] for r in bounds.collect()}  # a row a query
    floor = np.array([known.get(q, -np.inf) for q in queries.dictionary.to_pylist()])
    return rows.mapInArrow(_products(queries, keys, held["weight"].to_numpy(), limit, floor), kinds)


def _products(queries: pa.DictionaryArray, keys: pa.DictionaryArray, weights, limit: int, floor: np.ndarray):
    """A function of batches (doc_id, _k, x), a document's rows together, that gives (query_id, doc_id, score) that can be among a query's ``limit`` best, which reach its ``floor``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((len(keys.dictionary), len(queries.dictionary)))
        matrix[keys.indices.to_numpy(), queries.indices.to_numpy()] = weights
        best, rest = np.full((matrix.shape[1], limit), -np.inf), None
        for b in chain(batches, [None]):
            # a document may go on in the next batch
            parts = [*([rest] if rest is not None else []), *([pa.table(b)] if b is not None else [])]
            if not sum(p.num_rows for p in parts):
                continue
            table = pa.concat_tables(parts).combine_chunks()
            runs = pc.run_end_encode(table["doc_id"].chunk(0))
            ends = runs.run_ends.to_numpy()
            docs = ends[:-1] if b is not None else ends
            rest = table.slice(int(docs[-1]) if len(docs) else 0)
            k, x = table["_k"].to_numpy(), table["x"].to_numpy()
            for low in range(0, len(docs), ROWS):
                some = docs[low : low + ROWS]
                score = np.empty((len(some), matrix.shape[1]))
                at = int(docs[low - 1]) if low else 0
                for i, end in enumerate(some.tolist()):
                    own = matrix[k[at:end]]
                    score[i] = x[at:end] @ own
                    # a query that shares no key has no row; a shared key may add nothing (x is rounded)
                    score[i, score[i] == 0 if x[at:end].all() else ~own.any(0)] = -np.inf
                    at = end
                both = np.concatenate([best, score.T], 1)
                best = np.sort(np.partition(both, both.shape[1] - limit, 1)[:, -limit:], 1)
                q, j = np.nonzero((score.T >= np.maximum(best[:, 0], floor)[:, None] - SLACK) & (score.T > -np.inf))
                yield pa.RecordBatch.from_arrays([queries.dictionary.take(pa.array(q)), runs.values.take(pa.array(j + low)), pa.array(score[j, q])], ["query_id", "doc_id", "score"])

    return found


def best_bm25(posts: DataFrame, terms_: DataFrame, stats: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75, least: int = 3) -> DataFrame:
    """(query_id, doc_id, score, rank): the best sums of the weights of each query's terms (query_id, term). A weight is what is known of the term times what is known of the posting."""
    df, stats = posts.groupBy("term").agg(F.count("*").alias("df")), settle(stats)
    asked = settle(terms_.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", bm25_idf(F.col("df"), F.col("docs")).alias("weight")))
    x = bm25_share(F.col("tf"), F.col(f"size_{least}"), F.col("mean"), k1, b)
    return best_products(posts.crossJoin(F.broadcast(stats)).select("doc_id", "term", x.alias("x")), asked, "term", limit)


def bm25(docs: DataFrame, queries: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75, least: int = 3, posts: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) for queries (query_id, text). Postings are cut to the queries' terms before they are counted. posts: postings that are there already, of all these terms."""
    q = settle(query_terms(queries, least))
    tf = settle(postings(docs, (least,), q)) if posts is None else posts.where(F.char_length("term") >= least)
    return best_bm25(tf, q, corpus_stats(docs, least), limit, k1, b, least)


def best_sparse(posts: DataFrame, index: DataFrame, limit: int, least: int = 2, digits: int = 8) -> DataFrame:
    """``sparse_dot`` of the postings' sparse vectors and queries (query_id, idx, val), which are few beside them: vectors are made and compared where their document lies."""
    # a term of these postings is hashed once
    idx = settle(posts.select("term").distinct().select("term", T.hash_number(F.col("term"), digits).alias("idx")))
    own = by_document(posts.join(idx, "term")).groupBy("doc_id", "idx").agg(F.round(F.sum(F.col("tf") / F.col(f"size_{least}")), 6).alias("x"))
    return best_products(own, settle(index.select("query_id", "idx", F.col("val").alias("weight"))), "idx", limit)


def lexical_and_sparse(docs: DataFrame, queries: DataFrame, depth: int, more: DataFrame | None = None) -> DataFrame:
    """(query_id, list, id, rank): the full-text and the sparse list of each query (query_id, text), both from one table of postings. more: further terms (query_id, term) of the sparse list."""
    q = query_terms(queries)
    words = q if more is None else q.union(more.select("query_id", "term")).distinct()
    q, words = settle(q), settle(words)
    posts = settle(postings(docs, (2, 3), words))
    lexical = best_bm25(posts.where(F.char_length("term") >= 3), q, corpus_stats(docs), depth)
    index = words.groupBy("query_id", T.hash_number(F.col("term")).alias("idx")).agg(F.count("*").cast("double").alias("val"))
    sparse = best_sparse(posts, index, depth)
    return lexical.select("query_id", F.lit("lexical").alias("list"), F.col("doc_id").alias("id"), "rank").union(sparse.select("query_id", F.lit("sparse").alias("list"), F.col("doc_id").alias("id"), "rank"))


def suggestions(vocab: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return vocab.where(F.lower("term").startswith(prefix.lower())).orderBy(F.desc("doc_frequency"), F.desc("collection_frequency"), "term").limit(limit)


def expansions(queries: DataFrame, coll: DataFrame, most: int = 3, frequency: int = 5, broad: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, phrase, rank): collocations that share exactly one token with the query, by association times support.

    Queries (query_id, text) that hold a known phrase already get none; broad terms don't expand queries of three tokens and more.
    """
    tokens = queries.select("query_id", F.array_distinct(T.words(F.col("text"))).alias("tokens"))
    hit = settle(tokens.withColumn("token", F.explode("tokens")))
    known = settle(coll.where(F.col("frequency") >= frequency).select("term_a", "term_b", "pmi_score", "frequency"))
    # two equi joins in place of one with OR. Settled: collocations are made once, and the costly rules run on those that a query meets, not on all
    cols = ["query_id", "tokens", "token", "term_a", "term_b", "pmi_score", "frequency"]
    met = settle(hit.join(known, hit.token == known.term_a).select(*cols).union(hit.join(known, hit.token == known.term_b).select(*cols)))
    usable = T.is_informative_pair(F.col("term_a"), F.col("term_b")) & T.is_expansion_term(F.col("term_a")) & T.is_expansion_term(F.col("term_b"))
    found = met.where(usable).withColumn("weight", F.round(F.col("pmi_score") * F.log1p(F.greatest("frequency", F.lit(0))), 6))
    both = F.array_contains("tokens", F.col("term_a")) & F.array_contains("tokens", F.col("term_b"))
    holding = found.where(both).select("query_id").distinct()
    found = found.where(~both & ~((F.size("tokens") >= 3) & F.col("token").isin(*broad))).join(holding, "query_id", "left_anti")
    phrases = found.select("query_id", F.concat_ws(" ", "term_a", "term_b").alias("phrase"), "weight").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def lexical_topics(docs: DataFrame, rules: DataFrame, most: int = 3, reach: int = 1200) -> DataFrame:
    """(doc_id, topic, hits, confidence, rank) from marker rules (topic, position, marker).

    Markers of five letters and more, or of several words, count where they stand in the
    text's first ``reach`` characters, as the classifier re-expressed does; others as whole tokens. The rules are a
    dimension of known size.
    """
    head = docs.select("doc_id", F.lower(F.substring("text", 1, reach)).alias("low"))
    head = head.withColumn("tokens", T.words(F.col("low")))
    loose = (F.char_length("marker") >= 5) | F.col("marker").contains(" ")
    hits = head.crossJoin(F.broadcast(rules)).where(F.when(loose, F.contains("low", "marker")).otherwise(F.array_contains("tokens", F.col("marker"))))
    scored = hits.groupBy("doc_id", "topic", "position").agg(F.count("*").alias("hits")).withColumn("confidence", F.round(F.least(F.lit(0.9), 0.62 + 0.08 * F.col("hits")), 4))
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "position")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).drop("position")


def topic_rules(categories: DataFrame, rules: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(doc_id, topic, confidence): each category (doc_id, position, category) names at most one topic, the first rule (topic, rule, marker) not named before by that document.

    A fold over the document's categories in order: which rule is first depends on those before.
    """
    exact = categories.join(F.broadcast(rules), F.contains(F.lower("category"), F.col("marker")))
    options = exact.groupBy("doc_id", "position").agg(F.array_sort(F.collect_set(F.struct("rule", "topic"))).alias("options"))
    lists = options.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "options"))).alias("steps"))
    none = F.array().cast("array<string>")
    named = F.aggregate("steps", none, lambda seen, s: F.concat(seen, F.coalesce(F.slice(F.transform(F.filter(s["options"], lambda o: ~F.array_contains(seen, o["topic"])), lambda o: o["topic"]), 1, 1), none)))
    return lists.select("doc_id", F.explode(named).alias("topic"), F.lit(confidence).alias("confidence"))


def cooccurrence(bridge: DataFrame, most: int = 10) -> DataFrame:
    """(a, b, weight), a < b: how many items (item, entity) hold both, over each item's ``most`` smallest entities.

    The cap is the feature: it bounds the pairs of an item at most * (most - 1) / 2.
    """
    own = bridge.groupBy("item").agg(F.slice(F.array_sort(F.collect_set("entity")), 1, most).alias("e"))
    a = own.select("e", F.explode("e").alias("a"))
    return a.select("a", F.explode(F.filter("e", lambda x: x > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("weight"))


def expand_edges(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """(entity, weight): neighbours of the seeds (entity), without seeds, weights summed; strongest first."""
    s = seeds.select("entity").distinct()
    out = edges.join(s, edges.a == s.entity).select(F.col("b").alias("other"), "weight").union(edges.join(s, edges.b == s.entity).select(F.col("a").alias("other"), "weight"))
    got = out.join(s.select(F.col("entity").alias("other")), "other", "left_anti").groupBy("other").agg(F.sum("weight").alias("weight")).select(F.col("other").alias("entity"), "weight")
    return got.orderBy(F.desc("weight"), "entity").limit(limit) if limit else got


