"""Keys of the filtered side reach the database."""

import pytest

from conftest import SF, plan, rows
from vantage.catalog import Catalog
from vantage.plans.reduction import key_condition, reduced
from vantage.plans.worksheet import Worksheet
from vantage.sources import jdbc


@pytest.fixture(scope="module")
def cat(spark):
    cat = Catalog(spark)
    cat.register("rdb", "jdbc", url="jdbc:derby:memory:vantage_reduce;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver",
                 schema="APP", preferTimestampNTZ="true", partitions={"LINES": {"column": "l_orderkey", "num": 4}})
    cat.register("wh", "parquet", files=[f"{SF}/orders.parquet", f"{SF}/customer.parquet"])
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    jdbc.append(li, cat.connection("rdb"), "LINES", once=False)
    return cat


SQL = ("SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM wh__orders o JOIN rdb__LINES l ON o.o_orderkey = l.l_orderkey "
       "WHERE o.o_totalprice > {}")


def test_few_keys_are_a_list(spark, cat):
    price = spark.read.parquet(f"{SF}/orders.parquet").approxQuantile("o_totalprice", [0.98], 0.0)[0]
    whole = rows(Worksheet(cat).run(SQL.format(price)))
    ws = Worksheet(cat)
    ws.reduce("rdb", "LINES", "l_orderkey", f"SELECT o_orderkey FROM wh__orders WHERE o_totalprice > {price}")
    got = ws.run(SQL.format(price))
    assert "PushedFilters: [*In(l_orderkey" in plan(got).replace("[In", "[*In") or "In(l_orderkey" in plan(got)
    assert rows(got) == whole and len(whole) > 50


def test_many_keys_are_ranges(spark, cat):
    keys = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 300 OR o_orderkey > 1400").select("o_orderkey")
    scan = reduced(cat.scan("rdb", "LINES"), "l_orderkey", keys, values=10, ranges=8)
    pushed = plan(scan)
    assert "GreaterThanOrEqual(l_orderkey" in pushed and "In(l_orderkey" not in pushed
    want = cat.scan("rdb", "LINES").join(keys.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "left_semi")
    got = scan.join(keys.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey", "left_semi")
    assert rows(got) == rows(want) and scan.count() < cat.scan("rdb", "LINES").count()


def test_no_keys_nulls_and_other_types(spark, cat):
    none = spark.createDataFrame([(None,)], "k long")
    assert reduced(cat.scan("rdb", "LINES"), "l_orderkey", none).count() == 0
    some = spark.createDataFrame([(None,), (1,), (1,)], "k long")
    assert {r.l_orderkey for r in reduced(cat.scan("rdb", "LINES"), "l_orderkey", some).collect()} <= {1}
    assert key_condition(spark.createDataFrame([(1.5,)], "k double"), "x") is None
    texts = spark.range(30).selectExpr("CAST(id AS STRING) AS k")
    assert key_condition(texts, "x", values=10) is None and key_condition(texts, "x") is not None
