import pytest
from pyspark.sql import functions as F

from conftest import SF, plan, rows
from vantage.operators import shaping


@pytest.fixture()
def nested(spark):
    return spark.createDataFrame(
        [(1, ("ann", (1.5,)), ["x"]), (2, None, [])],
        "id int, u struct<n:string, g:struct<lat:double>>, tags array<string>")


def test_fill_null_token_strings_only(spark):
    df = spark.createDataFrame([(None, None, None)], "t string, n int, b boolean")
    r = shaping.fill_null_token(df).collect()[0]
    assert (r.t, r.n, r.b) == ("Null", None, None)


def test_flatten_one_level_and_full(nested):
    one = shaping.flatten(nested)
    assert one.columns == ["id", "u_n", "u_g", "tags"]
    full = shaping.flatten(nested, depth=None)
    assert full.columns == ["id", "u_n", "u_g_lat", "tags"]
    assert rows(full, "id", "u_n", "u_g_lat") == [(1, "ann", 1.5), (2, None, None)]


def test_flatten_quotes_dotted_names_and_handles_clash(spark):
    df = spark.createDataFrame([((1,), 2, (3,))],
                               "`a.b` struct<c:int>, u_g int, u struct<g:int>")
    with pytest.raises(shaping.NameClash):
        shaping.flatten(df)
    out = shaping.flatten(df, on_clash="suffix")
    assert out.columns == ["a.b_c", "u_g", "u_g_2"]
    assert out.collect()[0][0] == 1


def test_project_prunes_scan(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    p = plan(shaping.project(o, ["o_orderkey", "o_totalprice"]))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p
    with pytest.raises(KeyError):
        shaping.project(o, ["nope"])


def test_sort_nulls_explicit(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r.x for r in shaping.sort(df, ["x"]).collect()] == [None, 1, 3]
    assert [r.x for r in shaping.sort(df, ["x"], nulls="last").collect()] == [1, 3, None]
    assert [r.x for r in shaping.sort(df, [("x", "desc")]).collect()] == [3, 1, None]


def test_preview_is_top_k(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    top = shaping.preview(o, 5, order=[("o_totalprice", "desc"), "o_orderkey"])
    assert "TakeOrderedAndProject" in plan(top)
    want = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).collect()
    assert top.collect() == want


def test_search_any_column(spark):
    df = spark.createDataFrame([(1, "Alpha", 10.5, True), (2, "beta", 3.0, False),
                                (3, "x", 110.0, None)], "id int, s string, d double, b boolean")
    assert [r.id for r in shaping.search(df, "ALP").collect()] == [1]
    assert sorted(r.id for r in shaping.search(df, "10").collect()) == [1, 3]
    assert [r.id for r in shaping.search(df, "fals").collect()] == [2]
    assert shaping.search(df, "ALP", case_sensitive=True).count() == 0
    assert shaping.search(df, "zz").count() == 0


def test_structure_and_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "k bigint, v string")
    s = shaping.structure(df)
    assert rows(s) == [(1, "k", "bigint", True), (2, "v", "string", True)]
    p = shaping.structure(df, profile=True)
    assert rows(p, "column_name", "n_rows", "non_null") == [("k", 2, 2), ("v", 2, 1)]


def test_add_columns(spark):
    df = spark.createDataFrame([(2.0, 0.5)], "p double, d double")
    out = shaping.add_columns(df, {"net": "p * (1 - d)", "twice": F.col("p") * 2})
    assert out.collect()[0].asDict() == {"p": 2.0, "d": 0.5, "net": 1.0, "twice": 4.0}
