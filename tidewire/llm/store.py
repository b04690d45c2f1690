"""Where intermediate tables are kept, and how queries read their tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that goes to a Python worker: what bounds its memory, however long texts and sets are.
BATCH = 4 << 20
_BATCH, _CLEAN = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(df: DataFrame) -> DataFrame:
    """The table as it is; Arrow batches of its session are bounded by BATCH bytes from now on, where no other bound was set."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH))
    return df


@lru_cache(maxsize=4)
def _own_folder(app: str) -> str:
    return tempfile.mkdtemp(prefix="tidewire-")


def shared(spark: SparkSession) -> str:
    """The folder that all machines see: ``spark.checkpoint.dir``. Where it is unset, one machine alone gets a temporary folder; a cluster gets an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return _own_folder(spark.sparkContext.applicationId)


class Shelf:
    """Tables written as Parquet under the shared folder: lineage ends there, and a lost executor costs a read.

    Plans over them start at a scan, so they stay small however many rounds came before,
    and their sizes are known to the planner. A table is deleted by ``drop``, and what is
    left when the driver ends. A write's shuffle files go when it is over.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared(spark)}/tables/{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame, tasks: int | None = None) -> DataFrame:
        path, before = f"{self.base}/{len(self.paths)}", self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            (df.coalesce(tasks) if tasks else df).write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        if not self.paths:
            self._place(self.base, "deleteOnExit")
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = made
        return made

    def drop(self, *tables: DataFrame) -> None:
        for path, made in self.paths.items():
            if any(made is t for t in tables):
                self._place(path, "delete", True)

    def keep_only(self, *tables: DataFrame) -> DataFrame:
        """Deletes the others, and returns the first."""
        self.drop(*(t for t in self.paths.values() if not any(t is k for k in tables)))
        return tables[0]

    def _place(self, path: str, how: str, *more: bool) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(place.getFileSystem(self.spark._jsc.hadoopConfiguration()), how)(place, *more)


def settle(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read from there, until the driver ends."""
    return Shelf(df.sparkSession).put(df)


written = settle


def hot(counts: DataFrame, keys: list[str], rows: int, most: int = 4096) -> DataFrame:
    """(keys, salts) of the keys whose count ``n`` is at least rows / most: ``most`` at most, so they are collected and may be broadcast. salts: how many of these shares a key holds."""
    found = counts.where(F.col("n") >= max(2.0, rows / most)).select(*keys, F.ceil(F.col("n") * most / max(1, rows)).cast("int").alias("salts"))
    return F.broadcast(counts.sparkSession.createDataFrame(found.collect(), found.schema))
