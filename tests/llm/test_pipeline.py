"""The pipeline on a small folder of tables, against its stages' own laws."""

from __future__ import annotations

import pytest

from tests.llm.test_operators import SCHEMA, brute_components, corpus

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        columns = columns or before.columns
        assert docs.columns == columns
        if name == "MinHash near-dedup":
            rows = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect() if r["doc_id"] is not None}
            comp, _ = brute_components(rows.items())
            assert {r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] is not None} == set(comp.values())
    made = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert made.groupby("sequence_id")["length"].sum().max() <= 1024
    assert set(made["doc_id"].dropna()) == {r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] is not None}
    assert pipeline.run(spark, str(tmp_path)).count() == len(made)
