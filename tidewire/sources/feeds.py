"""Feeds and pages: files and payload columns to typed items. Fetching is not part of an engine; what was fetched is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T

#: Everything in a feed is text until it is parsed.
ITEM = "guid string, title string, link string, author string, pubDate string, description string, category array<string>, enclosure struct<_url: string, _type: string, _length: string>"


def read_rss(spark: SparkSession, path: str, schema: str = ITEM) -> DataFrame:
    """One row an <item>; a broken one doesn't stop the others."""
    return spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(schema).load(path)


def payload_items(payloads: DataFrame, column: str = "payload", schema: str = ITEM) -> DataFrame:
    """Items of a column of whole feeds."""
    channel = F.from_xml(F.col(column), F.lit(f"channel struct<item: array<struct<{schema.replace(' string', ': string').replace(' array', ': array').replace(' struct', ': struct')}>>>"))
    return payloads.withColumn("_item", F.explode(channel["channel"]["item"])).select(*(c for c in payloads.columns if c != column), "_item.*")


def items(raw: DataFrame, delimiter: str = " // ") -> tuple[DataFrame, DataFrame]:
    """Normalised items, and those without title or link as errors."""
    missing = (F.coalesce(F.trim("title"), F.lit("")) == "") | (F.coalesce(F.trim("link"), F.lit("")) == "")
    title, subtitle = T.title_parts(F.trim("title"), delimiter)
    when, inferred = T.rfc2822(F.col("pubDate"))
    good = raw.where(~missing).select(
        "guid", title.alias("title"), subtitle.alias("subtitle"), F.trim("link").alias("url"), T.canonical_url(F.col("link")).alias("canonical_url"),
        T.title_hash(F.col("title")).alias("title_hash"), T.html_text(F.col("description")).alias("text"), F.coalesce("category", F.array()).alias("categories"),
        T.author(F.col("author")).alias("author"), T.section(F.col("link")).alias("section"), when.alias("published_at"), inferred.alias("date_inferred"), T.is_breaking(F.col("title")).alias("is_breaking"), F.col("enclosure._url").alias("image_url"))
    return good, raw.where(missing).select("guid", "title", "link", F.lit("data_missing").alias("error"))


def unseen(fetches: DataFrame, states: DataFrame) -> DataFrame:
    """Fetches (source, version, ...) whose version token isn't the one recorded: what a conditional request would have returned."""
    return fetches.join(states.select("source", "version"), ["source", "version"], "left_anti")


#: Formats that are registered; others are an error.
READERS = {"rss": read_rss, "parquet": lambda spark, path: spark.read.parquet(path), "json": lambda spark, path: spark.read.json(path), "csv": lambda spark, path: spark.read.option("header", True).csv(path)}


def reader(kind: str):
    if kind not in READERS:
        raise ValueError(f"no reader for sources of kind {kind!r}")
    return READERS[kind]


def decoded(payload, declared: str | None = None):
    """Bytes as text: the declared charset, else UTF-8 where it is valid, else with replacements."""
    plain = F.try_validate_utf8(payload.cast("string"))
    return F.coalesce(F.decode(payload, declared), plain) if declared else F.coalesce(plain, F.make_valid_utf8(payload.cast("string")))


def child(xml, name: str):
    """Text of an item's first direct child of this name, with or without its prefix; null if there is none."""
    plain = name.strip().split(":", 1)[-1]
    path = f"/*/*[name() = '{name.strip()}' or name() = '{plain}'][1]"
    return F.when(F.xpath_boolean(xml, F.lit(path)), F.xpath_string(xml, F.lit(path)))


def related_links(xml, names: tuple[str, ...] = ("rbc_news:related_links", "yandex:related")):
    """Links of an item's block of related ones, as structs (url, title, img); links without an address are left out."""
    one = "|".join(names)
    found = F.regexp_extract_all(F.regexp_extract(xml, rf"(?s)<(?:{one})\b[^>]*>(.*?)</(?:{one})>", 1), F.lit(r"(?s)<link\b[^>]*/>|<link\b[^>]*>.*?</link>"), F.lit(0))

    def value(x, *attributes: str):
        return F.coalesce(*(F.nullif(F.trim(T.unescape(F.regexp_extract(x, rf"""(?s)^<link\b[^>]*?\s{a}\s*=\s*["']([^"']*)""", 1))), F.lit("")) for a in attributes))

    def made(x):
        inner = F.nullif(T.html_text(F.regexp_extract(x, r"(?s)^<link\b[^>]*>(.*)</link>$", 1)), F.lit(""))
        return F.struct(value(x, "url", "href").alias("url"), F.coalesce(value(x, "title"), inner).alias("title"), value(x, "img").alias("img"))

    return F.filter(F.transform(found, made), lambda r: r["url"].isNotNull())
