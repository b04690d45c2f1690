"""Alerts from lists that are cut before they are dealt out."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewire.operators import personal as P


def test_dealt_alerts_equal_dealing_out_all(spark):
    rng = random.Random(3)
    kinds = {"a": 0.9, "b": 0.95, "c": 0.8}
    lists = [spark.createDataFrame([(k, str(rng.randrange(4)), rng.randrange(30), rng.choice([None, 1, 2]), rng.choice([None, "x"]), s) for _ in range(80)], "alert_type string, key string, news_id long, entity_id long, topic_id string, score double") for k, s in kinds.items()]
    follows = spark.createDataFrame([(u, k, str(rng.randrange(6))) for u in range(12) for k in kinds for _ in range(2)] + [(1, "a", None)], "user_id long, alert_type string, key string")
    want = P.alerts([r.join(follows, ["alert_type", "key"]).drop("key") for r in lists], most=9)
    cols = ["user_id", "alert_type", "news_id", "entity_id", "topic_id", "score", "rank"]
    same = lambda df: sorted(map(str, df.select(cols).collect()))
    assert same(P.dealt_alerts(lists, follows, 9)) == same(want) and want.count() > 60


def test_an_entitys_long_list_is_cut_before_it_meets_followers(spark):
    """A thousand items and a thousand followers make no million rows on the way."""
    news = spark.range(1000).selectExpr("'a' AS alert_type", "'1' AS key", "id AS news_id", "1L AS entity_id", "CAST(null AS string) AS topic_id", "0.9D AS score")
    made = P.dealt_alerts([news], spark.range(1000).selectExpr("id AS user_id", "'a' AS alert_type", "'1' AS key"), 5)
    assert made.count() == 5000 and made.agg(F.max("news_id")).first()[0] == 4
