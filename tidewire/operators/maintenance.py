"""Statistics kept up to date by signed changes: what a batch of inserted, edited and deleted rows adds to and takes off counts.

A change is a row with ``sign``: the former state of a row with -1, its new state with +1. Counts of changes are those of
``corpus`` with the sign as weight, so a batch costs its own rows and the keys that they touch, not the corpus. Counts that are merged with such a delta equal
counts made anew, row by row: they are sums, and keys whose counts are 0 go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import corpus as C
from tidewire.sources.store import Scratch, upsert


def changes(current: DataFrame, batch: DataFrame, key: str, gone: str = "deleted") -> DataFrame:
    """The rows of both with ``sign``: former rows of the batch's keys with -1, its own with +1 but for those that only delete. A key stands once in the batch; ``gone`` is true where it deletes."""
    columns = current.columns
    former = current.join(batch.select(key), key, "left_semi").select(*columns, F.lit(-1).alias("sign"))
    return former.unionByName(batch.where(~F.coalesce(F.col(gone), F.lit(False))).select(*columns, F.lit(1).alias("sign")))


def applied(current: DataFrame, batch: DataFrame, key: str, gone: str = "deleted") -> DataFrame:
    """The rows after the batch."""
    return current.join(batch.select(key), key, "left_anti").unionByName(batch.where(~F.coalesce(F.col(gone), F.lit(False))).select(*current.columns))


def merged(counts: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The counts with the delta's added; keys all of whose counts are 0 go."""
    values = [c for c in counts.columns if c not in keys]
    made = counts.unionByName(delta.select(*counts.columns)).groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))
    some = F.lit(False)
    for v in values:
        some = some | (F.col(v) != 0)
    return made.where(some).select(*counts.columns)


def term_delta(signed: DataFrame, least: int = 2) -> DataFrame:
    """(term, doc_frequency, collection_frequency) that changed documents (doc_id, text, sign) add."""
    each = signed.select("doc_id", "sign", F.explode(T.words(F.col("text"), least)).alias("term"))
    own = each.groupBy("term", "doc_id", "sign").agg(F.count("*").alias("n"))
    return own.groupBy("term").agg(F.sum("sign").cast("long").alias("doc_frequency"), F.sum(F.col("sign") * F.col("n")).alias("collection_frequency"))


def term_rows(rows: DataFrame, least: int = 2) -> DataFrame:
    """(term, n) of documents (doc_id, text, and sign where they are changes): what each occurrence adds, for ``merged`` to sum in one shuffle."""
    sign = F.col("sign") if "sign" in rows.columns else F.lit(1)
    return rows.select(sign.cast("long").alias("n"), F.explode(T.words(F.col("text"), least)).alias("term")).select("term", "n")


def pair_rows(rows: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n) of useful pairs of neighbours, as ``term_rows``."""
    signs = (1, -1) if "sign" in rows.columns else (None,)
    parts = [C.pairs(rows if s is None else rows.where(F.col("sign") == s), least).withColumn("n", F.lit(s or 1).cast("long")) for s in signs]
    return reduce(DataFrame.unionByName, parts).where(C.useful_pair(F.col("a"), F.col("b")))


def pair_delta(signed: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n): neighbours that changed documents add."""
    parts = [C.pairs(signed.where(F.col("sign") == s), least).groupBy("a", "b").agg((F.count("*") * s).alias("n")) for s in (1, -1)]
    return parts[0].unionByName(parts[1]).groupBy("a", "b").agg(F.sum("n").alias("n"))


def edge_delta(former: DataFrame, new: DataFrame, most: int = 10) -> DataFrame:
    """(a, b, weight) that items (item, entity) add, their former entities taken off and the new ones put in. An item's cap of ``most`` is applied to each state, so an entity that moves under it brings its edges."""
    return C.cooccurrence(new, most).unionByName(C.cooccurrence(former, most).withColumn("weight", -F.col("weight"))).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def top_collocations(coll: DataFrame, most: int = 1000) -> DataFrame:
    """What a loader keeps: the most frequent ``most``, then the strongest."""
    return coll.orderBy(F.desc("frequency"), F.desc("pmi_score"), "term_a", "term_b").limit(most)


def upsert_files(spark: SparkSession, path: str, batch: DataFrame, key: str, version: str, buckets: int = 64) -> None:
    """Puts rows into a table of files (``path``) by key, the newest version of each: only buckets that the batch touches are read and written.

    Rows lie in ``buckets`` by a hash of the key, which must stay the same for a table. Buckets are replaced one by one when all are written (dynamic partition
    overwrite), so a run that fails before leaves the table as it was, and one that is repeated gives the same.
    """
    new = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    if not _there(spark, path):
        upsert(new.limit(0), new, key, version).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        return
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # numbers of buckets
    if not touched:
        return
    scratch = Scratch(spark)
    old = spark.read.parquet(path).withColumn("_bucket", F.col("_bucket").cast("long")).where(F.col("_bucket").isin(touched))
    made = scratch.put(upsert(old.select(*new.columns), new, key, version))
    made.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    scratch.drop(made)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
