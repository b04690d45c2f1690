"""The queries of this subpackage, one for each operator with its production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import centroids, divergence, fingerprint, linededup, media, mixing, near, packing, privacy, quality, sharding, simhash, toxicity
from tidewire.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", "taken")


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    """Path of the vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.clean(table(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = privacy.detect(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_private")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return media.recordings(docs.select("doc_id", F.col("text").cast("binary").alias("samples")), media.TEXT)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_media, op2_mixing, op3_shards, op4_lines, op5_near, op6_fingerprint, op7_toxicity, op8_packing, op9_privacy, op10_quality, op11_simhash, op12_divergence, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE, "op5_near": near.ORACLE, "op12_divergence": divergence.ORACLE, "op13_centroids": centroids.ORACLE}
