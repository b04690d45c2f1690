"""Intermediate tables that outlive executors, and tables that are merged by key."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker: what bounds its memory, however long pages and texts are.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession | None = None) -> None:
    """Arrow batches of the session (the active one) are bounded by BATCH bytes from now on, where no other bound was set."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH))


@lru_cache(maxsize=4)
def _own_folder(app: str) -> str:
    return tempfile.mkdtemp(prefix="tidewire-")


def shared(spark: SparkSession) -> str:
    """The folder that all machines see, ``spark.checkpoint.dir``. Where it is unset, one machine alone gets a temporary folder; a cluster gets an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _own_folder(spark.sparkContext.applicationId)


class Scratch:
    """Tables under the shared folder that end their lineage: plans over them start at a scan, and a lost executor costs a read. ``drop`` deletes one; the rest go when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.made = spark, f"{shared(spark)}/scratch/{uuid.uuid4().hex}", []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.made)}"
        df.write.parquet(path)
        if not self.made:
            self._place(self.base, "deleteOnExit")
        table = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((path, table))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for path, table in self.made:
            if any(table is t for t in tables):
                self._place(path, "delete", True)

    def _place(self, path: str, how: str, *more: bool) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(place.getFileSystem(self.spark._jsc.hadoopConfiguration()), how)(place, *more)


def settle(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder, as Parquet, and read from there until the driver ends: lineage ends there, its size is known to the planner, and its columns are packed."""
    return Scratch(df.sparkSession).put(df)


def insert_new(existing: DataFrame, batch: DataFrame, key: str, order: list) -> DataFrame:
    """Rows of the batch to insert: the first of each key by ``order``, without keys that exist (ON CONFLICT DO NOTHING)."""
    first = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")
    return first.join(existing.select(key), key, "left_anti")


def upsert(existing: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """Latest row of each key over both (ON CONFLICT DO UPDATE); on equal versions the batch wins."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_new")


def patch(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Existing rows with the non-null values of ``changes`` put in."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    made = existing.join(new, key, "left")
    return made.select(*(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if f"_new_{c}" in new.columns else F.col(c) for c in existing.columns))


def delete_missing(existing: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Existing rows whose key is in the keep-set."""
    return existing.join(keep.select(key).distinct(), key, "left_semi")


def retained(rows: DataFrame, ts: str, as_of, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and the dry-run count of those that go."""
    gone = F.col(ts) < as_of - F.expr(f"INTERVAL {days} DAY")
    return rows.where(~gone | F.col(ts).isNull()), rows.agg(F.count_if(gone).alias("deleted"), F.count("*").alias("total"))


def publish(df: DataFrame, base: str, version: str, view: str) -> None:
    """Write a version beside the others, then point the view to it (blue/green)."""
    path = f"{base.rstrip('/')}/{version}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.parquet(path).createOrReplaceTempView(view)
