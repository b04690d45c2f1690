"""Hooks for models that an engine doesn't hold: lemmas, entities, embeddings, zero-shot topics, rerankers.

A hook is a function over Arrow batches that a caller registers; operators take what it makes as tables. Each has a
deterministic fallback, which the registered queries use. ``make`` loads a model and is called once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as T


def applied(rows: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows through a model, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            yield model(batch)

    return rows.mapInArrow(run, schema)


def lemmas(docs: DataFrame, make=None) -> DataFrame:
    """(doc_id, lemmas): the model's, else lower-cased tokens."""
    if make:
        return applied(docs.select("doc_id", "text"), make, "doc_id long, lemmas array<string>")
    return docs.select("doc_id", T.words(F.col("text")).alias("lemmas"))


def entities(docs: DataFrame, make=None, pattern: str = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}{3,}(?![\p{L}\p{N}])") -> DataFrame:
    """(doc_id, pos, text, normal, kind): spans of the model, else capitalised words of four letters and more."""
    if make:
        return applied(docs.select("doc_id", "text"), make, "doc_id long, pos int, text string, normal string, kind string")
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "text"))
    return found.select("doc_id", "pos", "text", F.lower("text").alias("normal"), F.lit("name").alias("kind"))


def embeddings(docs: DataFrame, make=None, dims: int = 64) -> DataFrame:
    """(doc_id, vector): the model's, else counts of tokens by hash."""
    if make:
        return applied(docs.select("doc_id", "text"), make, "doc_id long, vector array<float>")
    tokens = docs.select("doc_id", F.explode(T.words(F.col("text"))).alias("t")).groupBy("doc_id", F.pmod(T.hash_number(F.col("t")), F.lit(dims)).cast("int").alias("i")).agg(F.count("*").alias("n"))
    lists = tokens.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    return lists.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("float")).alias("vector"))


def lexical_weights(weights) -> tuple:
    """Indices and values of a map from tokens' numbers to weights, in order, without zeros."""
    kept = F.array_sort(F.filter(F.map_entries(weights), lambda e: e["value"] != 0))
    return F.transform(kept, lambda e: e["key"]), F.transform(kept, lambda e: e["value"])
