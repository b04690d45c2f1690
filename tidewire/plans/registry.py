"""Registered queries: a name, a function of (spark, folder of tables), and SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables."""

    def add(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or make.__name__
        QUERIES[key] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            SQL[key] = sql
        return make

    return add
