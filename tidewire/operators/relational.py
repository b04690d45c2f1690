"""Feed, dimension and reconciliation operators over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feed(articles: DataFrame, order: list[Column], offset: int = 0, limit: int = 20, where: list[Column] | None = None, blocked: DataFrame | None = None, key: str = "source_id") -> DataFrame:
    """A page of the feed with the total of all pages: filters, blocked sources out, ordered, cut by a top-k and not by a full sort."""
    rows = articles
    for w in where or []:
        rows = rows.where(w)
    if blocked is not None:
        rows = rows.join(blocked.select(key), key, "left_anti")
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def top_lists(bridge: DataFrame, key: str, value: str, order: list[Column], most: int) -> DataFrame:
    """(key, values): each key's first ``most`` values in order, as a correlated ARRAY(SELECT ... LIMIT k) gives."""
    rows = bridge.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= most)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", value))), lambda x: x[value]).alias("values"))


def orphans(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def reconciled(stored: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """(key, status): ``missing`` in the index, ``orphan`` there, or ``ok``."""
    a, b = stored.select(F.col(key).alias("_a")).distinct(), indexed.select(F.col(key).alias("_b")).distinct()
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return both.select(F.coalesce("_a", "_b").alias(key), F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "orphan").otherwise("ok").alias("status"))


def fact_counts(keys: DataFrame, key: str, facts: dict[str, DataFrame]) -> DataFrame:
    """Counts of several fact tables by key, 0 where there are none: one union and one pivot, not a join a table."""
    rows = None
    for name, df in facts.items():
        part = df.select(F.col(key), F.lit(name).alias("fact"))
        rows = part if rows is None else rows.union(part)
    wide = rows.groupBy(key).pivot("fact", list(facts)).count()
    return keys.join(wide, key, "left").select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in facts))


def known_until(items: DataFrame) -> DataFrame:
    """Items newer than the newest known one of their source (source, ts, url, known), and how many known ones the whole feed has."""
    newest = Window.partitionBy("source").orderBy(F.desc("ts"), F.desc("url"))
    whole = Window.partitionBy("source")
    rows = items.withColumn("_rn", F.row_number().over(newest))
    rows = rows.withColumn("_stop", F.min(F.when(F.col("known"), F.col("_rn"))).over(whole)).withColumn("duplicates", F.count_if("known").over(whole))
    return rows.where(F.col("_stop").isNull() | (F.col("_rn") < F.col("_stop"))).drop("_rn", "_stop")


def in_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of listed ids (list_id, ids) in the list's order: (list_id, place, all columns of rows). Ids without a row are left out, and the places of the others stay."""
    asked = ids.select("list_id", F.posexplode("ids").alias("place", key))
    return asked.join(rows, key).select("list_id", F.col("place").cast("long").alias("place"), *rows.columns)


def with_defaults(rows: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Rows with the dimension's columns; what is missing there has its default."""
    made = rows.join(dimension, key, "left")
    return made.select(*(F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in made.columns))


def updated_from(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with ``columns`` set from the changes' row of their key, nulls too; rows without one stay (UPDATE ... FROM)."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    return rows.join(new, key, "left").select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def repaired(articles: DataFrame, indexed: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What brings an index (key) in line with its articles: keys to index anew, indexed keys that have no article, and the counts (missing, orphaned, total) in one row."""
    a, b = articles.select(key).distinct(), indexed.select(key).distinct()
    missing, orphaned = a.join(b, key, "left_anti"), b.join(a, key, "left_anti")
    counts = missing.agg(F.count("*").alias("missing")).crossJoin(orphaned.agg(F.count("*").alias("orphaned"))).crossJoin(a.agg(F.count("*").alias("total")))  # a row each
    return missing, orphaned, counts


def validated(requests: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Requests with ``errors``: the names of the rules (conditions that must hold; null doesn't) that each breaks, in order."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return requests.withColumn("errors", broken)
