"""Joins on a key that holds most of the rows."""

import pytest
from meterlake.llm import common, simhash
from pyspark.sql import functions as F


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_spread_join_equals_a_plain_join(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rows = spark.range(3000).select(F.col("id").alias("v"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k")).repartition(4)
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).filter("k <> 9")
    want = rows.join(keyed.drop("n"), "k")
    assert sorted(map(tuple, common.spread_join(rows, keyed.drop("n"), "k", keyed).collect())) == sorted(map(tuple, want.collect()))


def test_one_group_of_100000_equal_texts(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("the same words over and over").alias("text")).union(spark.createDataFrame([(200_000, "other words here"), (200_001, None)], "doc_id long, text string"))
    got = simhash.near_duplicates(docs)
    assert {tuple(r) for r in got.groupBy("component").count().collect()} == {(0, 100_000), (200_000, 1), (200_001, 1)}


def test_a_hub_of_edges(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    star = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(5000).cast("long").alias("b")).union(spark.createDataFrame([(7000, 7001), (7001, 7002)], "a long, b long"))
    roots = {r["node"]: r["root"] for r in simhash.components(star).collect()}
    assert set(roots.values()) == {1, 7000} and len(roots) == 3003 and roots[5000] == 1
