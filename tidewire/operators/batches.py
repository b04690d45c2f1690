"""Batches of articles worked through once: what fails is set apart row by row, the rest goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.functions import dom
from tidewire.functions import extract as X
from tidewire.operators.retrieval import ranked


def isolated(rows: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, key: str) -> DataFrame:
    """``work`` on Arrow batches of ``rows``: its rows (schema) with ``failed_key`` and ``error`` null, and a row for each input row on which it fails, all else null.

    A batch that fails is halved until the failing rows are alone, so n failing rows of a batch of m cost about n * log(m) calls, and a batch
    without any costs one. A row of the input may give any number of rows. ``work`` must not keep state between calls: rows are worked on again.
    """
    fields = rows.sparkSession.createDataFrame([], schema).schema
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        try:
            made = work(batch)
        except Exception as exc:
            if batch.num_rows > 1:
                half = batch.num_rows // 2
                yield from each(batch.slice(0, half))
                yield from each(batch.slice(half))
                return
            yield failed(batch, exc)
            return
        none = pa.nulls(made.num_rows, pa.string())
        yield pa.RecordBatch.from_arrays([*(made[n].cast(t) for n, t in zip(names, types, strict=True)), none, none], [*names, "failed_key", "error"])

    def failed(batch: pa.RecordBatch, exc: Exception) -> pa.RecordBatch:
        told = f"{type(exc).__name__}: {exc}"[:500]
        value = batch[key][0].as_py()
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), pa.array([None if value is None else str(value)], pa.string()), pa.array([told])], [*names, "failed_key", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from each(b)

    return rows.mapInArrow(run, f"{schema}, failed_key string, error string")


def run_batch(pending: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, key: str, scratch, limit: int | None = None, order: list[Column] = (), publish: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``limit`` first pending rows (all without one) worked through: what came of them, the dead letters (key, error), and one row of counts (selected, processed, skipped, failed).

    The results are written once, both tables are read from there, and ``publish`` gets the processed keys once, after the write. A row that gives no result without failing is skipped. Schema has ``key``.
    """
    chosen = scratch.put(pending.orderBy(*order).limit(limit) if limit else pending)
    made = scratch.put(isolated(chosen, work, schema, key))
    good, dead = made.where("error IS NULL").drop("failed_key", "error"), made.where("error IS NOT NULL").select(F.col("failed_key").alias(key), "error")
    done = good.select(key).distinct()
    if publish is not None:
        publish(done)
    one = chosen.agg(F.count("*").alias("selected")).crossJoin(done.agg(F.count("*").alias("processed"))).crossJoin(dead.agg(F.count("*").alias("failed")))  # a row each
    return good, dead, one.select("selected", "processed", (F.col("selected") - F.col("processed") - F.col("failed")).alias("skipped"), "failed")


def pending(articles: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` articles of each source that wait for their text: (id, source, published, content, status, ...) without content, partial or failed."""
    rows = articles.where(F.col("content").isNull() & F.col("status").isin("partial", "extraction_failed"))
    return ranked(rows, ["source"], [F.desc_nulls_last("published"), F.desc("id")], limit, "_rn").drop("_rn")


def enriched(waiting: DataFrame, pages: DataFrame, extractor: dom.Extractor, rules: list[tuple[str, str]] = (), lead_after_title: tuple[str, ...] = (), title_alone: tuple[str, ...] = ()) -> DataFrame:
    """Every waiting article (id, source, site, url, title) with content, status, method and tags from its page (url, code, html).

    No page, or one without an answer, is a failed extraction by ``http_error``; so is any code but 200, and 401, 403 and 451 are a paywall, which isn't asked again. Pages go through the cascade of
    ``extract.levels``, the rules, and lose a repeated title where the source does that, with the lead behind it (``lead_after_title``) or alone.
    """
    rows = waiting.join(pages.select("url", "code", "html").dropDuplicates(["url"]), "url", "left")
    rows = rows.withColumn("_found", extractor.column(F.when(F.col("code") == 200, F.col("html")), F.col("site")))
    text, status, method = X.levels(F.col("_found"))
    rows = rows.withColumn("_text", X.apply_rules(text, list(rules)))
    source = F.col("source").cast("string")
    clean = F.when(source.isin(*lead_after_title), X.without_title(F.col("_text"), F.col("title"), lead=True)).when(source.isin(*title_alone), X.without_title(F.col("_text"), F.col("title"))).otherwise(F.col("_text"))
    answered = F.coalesce(F.col("code") == 200, F.lit(False))
    wall = F.coalesce(F.col("code").isin(401, 403, 451), F.lit(False))
    return rows.select(
        "id", "source", F.when(answered, clean).alias("content"), F.when(answered, status).when(wall, "paywall").otherwise("extraction_failed").alias("status"),
        F.when(answered, method).otherwise("http_error").alias("method"), F.when(answered, F.col("_found.tags")).alias("tags"), F.col("code").alias("http_status"))


def enrichment_runs(articles: DataFrame, done: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, items_total, items_enriched, items_failed, status, followup_needed): one row a source (of ``asked``: source, rerun_requested). done: ``enriched``.

    A follow-up is due where the run got on or nothing failed, and another was asked for or articles still wait.
    """
    counts = done.groupBy("source").agg(F.count("*").alias("total"), F.count("content").alias("good"))
    still = articles.where(F.col("content").isNull() & F.col("status").isin("partial", "extraction_failed")).join(done.select("id", F.col("status").alias("_new"), F.col("content").alias("_content")), "id", "left")
    still = still.where(F.col("_new").isNull() | (F.col("_content").isNull() & F.col("_new").isin("partial", "extraction_failed"))).select("source").distinct().withColumn("_more", F.lit(True))
    rows = asked.join(counts, "source", "left").join(still, "source", "left")
    total, good = F.coalesce("total", F.lit(0)), F.coalesce("good", F.lit(0))
    follow = (total > 0) & ((good > 0) | (total == good)) & (F.col("rerun_requested") | F.coalesce("_more", F.lit(False)))
    return rows.select("source", total.alias("items_total"), good.alias("items_enriched"), (total - good).alias("items_failed"), F.when(total > good, "partial").otherwise("success").alias("status"), follow.alias("followup_needed"))
