"""Every registered query runs on the smallest tables, and agrees with its SQL there; the llm subpackage may be absent."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tidewire.plans import QUERIES, SQL
from tidewire.plans.events import LABELS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("~" if v is None or str(v) in ("<NA>", "NaT", "nan") else f"{float(v):.5g}" if isinstance(v, float) or type(v).__name__ in ("float64", "Decimal") else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    sql = SQL.get(name) or (LABELS if name == "event_cluster_labels" else None)  # too slow on larger tables
    if sql:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in os.listdir(FOLDER):
            con.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
