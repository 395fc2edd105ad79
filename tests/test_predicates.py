import pytest
from pyspark.sql import types as T

from conftest import SF, plan, rows
from vantage.operators.predicates import (FilterSpec, UnknownFilterOp, apply_filters,
                                          from_records, remove_filter, upsert_filter)
from vantage.operators.shaping import fill_null_token

NULLS_SCHEMA = T.StructType([T.StructField("id", T.IntegerType()),
                             T.StructField("n", T.IntegerType()),
                             T.StructField("t", T.StringType()),
                             T.StructField("b", T.BooleanType())])


@pytest.fixture()
def nulls(spark):
    data = [(1, 1, "Null", True), (2, None, None, None), (3, 3, " Null ", False),
            (4, 4, "  padded  ", True), (5, 10, "plain", None)]
    return spark.createDataFrame(data, NULLS_SCHEMA)


@pytest.fixture()
def wild(spark):
    data = [(1, "100%"), (2, "a_b"), (3, "axb"), (4, "back\\slash"), (5, "MiXeD"), (6, "100 pct")]
    return spark.createDataFrame(data, "id int, s string")


def ids(df):
    return [r[0] for r in rows(df, "id")]


def test_equal_trims_both_sides(nulls):
    assert ids(apply_filters(nulls, [FilterSpec("equal", "t", "padded")])) == [4]
    assert ids(apply_filters(nulls, [FilterSpec("equal", "t", "  padded\t")])) == [4]


def test_equal_on_int_compares_text(nulls):
    assert ids(apply_filters(nulls, [FilterSpec("equal", "n", "1")])) == [1]
    assert ids(apply_filters(nulls, [FilterSpec("equal", "n", "1.0")])) == []


def test_equal_double_text(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 12345678.9), (3, 2.5)], "id int, x double")
    assert ids(apply_filters(df, [FilterSpec("equal", "x", "1.0")])) == [1]
    assert ids(apply_filters(df, [FilterSpec("equal", "x", "1.23456789E7")])) == [2]


def test_not_equal_true_nulls_drop(nulls):
    assert ids(apply_filters(nulls, [FilterSpec("not equal", "t", "plain")])) == [1, 3, 4]


def test_not_equal_token_mode_keeps_string_nulls(nulls):
    got = ids(apply_filters(nulls, [FilterSpec("not equal", "t", "plain", nulls="token")]))
    assert got == [1, 2, 3, 4]
    # numbers keep true nulls in token mode too: they drop out
    got = ids(apply_filters(nulls, [FilterSpec("not equal", "n", "3", nulls="token")]))
    assert got == [1, 4, 5]


def test_null_and_not_null_true_mode(nulls):
    assert ids(apply_filters(nulls, [FilterSpec("null", "t")])) == [2]
    assert ids(apply_filters(nulls, [FilterSpec("null", "n")])) == [2]
    assert ids(apply_filters(nulls, [FilterSpec("null", "b")])) == [2, 5]
    assert ids(apply_filters(nulls, [FilterSpec("not null", "n")])) == [1, 3, 4, 5]


def test_null_token_mode_matches_viewer(nulls):
    # the text 'Null' and a null string both read as the token; null numbers never match
    assert ids(apply_filters(nulls, [FilterSpec("null", "t", nulls="token")])) == [1, 2, 3]
    assert ids(apply_filters(nulls, [FilterSpec("null", "n", nulls="token")])) == []
    assert ids(apply_filters(nulls, [FilterSpec("not null", "n", nulls="token")])) == [1, 3, 4, 5]


def test_contains_family(wild):
    assert ids(apply_filters(wild, [FilterSpec("contains", "s", "%")])) == [1]
    assert ids(apply_filters(wild, [FilterSpec("not contains", "s", "_")])) == [1, 3, 4, 5, 6]
    assert ids(apply_filters(wild, [FilterSpec("starts with", "s", "100")])) == [1, 6]
    assert ids(apply_filters(wild, [FilterSpec("ends with", "s", "\\slash")])) == [4]
    assert ids(apply_filters(wild, [FilterSpec("contains", "s", "mixed")])) == []  # case-sensitive


def test_like_mode_keeps_wildcards(wild):
    assert ids(apply_filters(wild, [FilterSpec("contains", "s", "a_b", mode="like")])) == [2, 3]
    assert ids(apply_filters(wild, [FilterSpec("starts with", "s", "100%", mode="like")])) == [1, 6]


def test_filter_set_and_removal(nulls):
    specs = [FilterSpec("not null", "n", id="a"), FilterSpec("contains", "t", "l", id="b")]
    assert ids(apply_filters(nulls, specs)) == [1, 3, 5]  # "padded" has no "l"
    specs = upsert_filter(specs, FilterSpec("equal", "t", "plain", id="b"))
    assert ids(apply_filters(nulls, specs)) == [5]
    assert ids(apply_filters(nulls, remove_filter(specs, "b"))) == [1, 3, 4, 5]


def test_records_and_unknown_op(nulls):
    recs = {"x": {"logic1_op": "equal", "logic1_val": "3", "column_name": "n",
                  "condition": "condition"}}
    assert ids(apply_filters(nulls, from_records(recs))) == [3]
    with pytest.raises(UnknownFilterOp):
        FilterSpec("greater", "n", "1")


def test_token_fill_then_filter_equals_token_mode(nulls):
    a = ids(apply_filters(fill_null_token(nulls), [FilterSpec("equal", "t", "Null")]))
    b = ids(apply_filters(nulls, [FilterSpec("equal", "t", "Null", nulls="token")]))
    assert a == b == [1, 2, 3]


def test_pushdown_reaches_parquet_scan(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    p = plan(apply_filters(o, [FilterSpec("equal", "o_orderstatus", "F"),
                               FilterSpec("starts with", "o_orderdate", "1997-01")]))
    assert "EqualTo(o_orderstatus,F)" in p
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = plan(apply_filters(li, [FilterSpec("equal", "l_linenumber", "3")]))
    assert "EqualTo(l_linenumber,3)" in p


def test_pushdown_hints_do_not_change_results(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    spec = FilterSpec("starts with", "o_orderdate", "1996-12")
    got = apply_filters(o, [spec]).count()
    want = o.filter("startswith(cast(o_orderdate as string), '1996-12')").count()
    assert got == want > 0


def test_decimal_hints_and_exact_mode(spark):
    df = spark.createDataFrame([("1.50", "a"), ("2.00", " a")], "d string, s string").selectExpr(
        "CAST(d AS DECIMAL(10,2)) AS d", "s")
    for v, n in (("NaN", 0), ("9" * 45, 0), ("1e999", 0), ("1.50", 1)):
        assert apply_filters(df, [FilterSpec("equal", "d", v)]).count() == n
    assert apply_filters(df, [FilterSpec("equal", "s", "a")]).count() == 2
    assert apply_filters(df, [FilterSpec("equal", "s", "a", mode="exact")]).count() == 1
    assert apply_filters(df, [FilterSpec("starts with", "s", " ", mode="exact")]).count() == 1
