"""K1: a key with a third of the rows fills no bucket."""

import pytest
from pyspark.sql import functions as F

from conftest import SF, plan, rows
from vantage.operators import hotkeys


@pytest.fixture(scope="module")
def sides(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    hot = li.withColumn("l_orderkey", F.when(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == 0, 1).otherwise(F.col("l_orderkey")))
    o = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return hot, o.where("l_orderkey % 7 <> 3")


def test_the_hot_key_is_spread(spark, sides):
    large, other = sides
    left, right = hotkeys.materialise_pair(large, other, "l_orderkey", 16)
    total = large.count()
    hot = hotkeys.hot_keys(large, "l_orderkey", 16).collect()
    assert [(r.l_orderkey, r.salts) for r in hot] == [(1, 6)] and hot[0].n == large.where("l_orderkey = 1").count()
    sizes = hotkeys.rows_by_bucket(left)
    assert len(sizes) == 16 and sizes[0] < 3.5 * total / 16
    plain = hotkeys.sinks.materialise(large, table="plain", bucket_by=(16, ["l_orderkey"]))
    assert hotkeys.rows_by_bucket(plain)[0] > total / 3
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = hotkeys.join_pair(left, right, "l_orderkey", how)
        want = large.join(other, "l_orderkey", how)
        assert got.count() == want.count()
        assert got.select(sorted(got.columns)).exceptAll(want.select(sorted(want.columns))).count() == 0
    joined = plan(hotkeys.join_pair(left, right, "l_orderkey"))
    assert "SortMergeJoin" in joined and "Exchange" not in joined


def test_without_hot_keys_and_with_nulls(spark):
    a = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    b = spark.range(0, 1000, 3).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    left, right = hotkeys.materialise_pair(a, b, "k", 4)
    assert right.count() == b.count() and rows(left, "v") == rows(a, "v")
    assert rows(hotkeys.join_pair(left, right, "k"), "v") == rows(a.join(b, "k"), "v")
    assert hotkeys.join_pair(left, right, "k", "left").count() == 1000
    with pytest.raises(ValueError):
        hotkeys.join_pair(left, right, "k", "full")
    with pytest.raises(ValueError):
        hotkeys.salted(a.withColumn("__salt", F.lit(1)), b, "k", 4)
