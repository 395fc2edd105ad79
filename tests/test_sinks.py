import os

from conftest import SF
from vantage.catalog import Catalog
from vantage.operators import sinks


def test_materialise_keeps_types_and_serves_scans(spark, tmp):
    df = spark.createDataFrame([(1, None), (None, "x")], "n int, s string")
    cat = Catalog(spark)
    cat.register("c", "parquet", files=[f"{SF}/nation.parquet"])
    back = sinks.materialise(df, os.path.join(tmp, "m"), catalog=cat, connection="c",
                             table="nation", structure_path=os.path.join(tmp, "struct"))
    assert back.dtypes == [("n", "int"), ("s", "string")]
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    assert cat.scan("c", "nation").columns == ["n", "s"]  # S8: the copy is read
    st = spark.read.parquet(os.path.join(tmp, "struct"))
    assert [r.column_name for r in st.orderBy("position").collect()] == ["n", "s"]


def test_export_formats_roundtrip(spark, tmp):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    ddl = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
           "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")
    for fmt in ("csv", "json", "parquet"):
        path = os.path.join(tmp, fmt)
        sinks.export(o, path, fmt=fmt, max_records_per_file=400)
        reader = spark.read.schema(ddl)
        back = {"csv": lambda: reader.option("header", True).csv(path),
                "json": lambda: reader.json(path),
                "parquet": lambda: spark.read.parquet(path)}[fmt]()
        assert back.exceptAll(o).count() == 0 and o.exceptAll(back).count() == 0, fmt
    files = [f for f in os.listdir(os.path.join(tmp, "csv")) if f.endswith(".csv")]
    assert len(files) >= 4  # 1500 rows at most 400 per file


def test_csv_export_keeps_every_cell(spark, tmp):
    cells = ["  x ", "", None, "a,b", 'say "hi"', "two\nlines", "cr\r\nlf\r", "\ttab", '"', "\\", "é ü", "NULL", "null"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, s string")
    path = sinks.export(df, os.path.join(tmp, "cells"), fmt="csv")
    cat = Catalog(spark)
    cat.register("c", "csv", files=[path], schemas={"cells": "id int, s string"}, read_options=sinks.READ_CSV)
    assert [r.s for r in cat.scan("c", "cells").orderBy("id").collect()] == cells


def test_create_table_registers(spark, tmp):
    cat = Catalog(spark)
    cat.register("wh", "parquet", files=[f"{SF}/nation.parquet", f"{SF}/region.parquet"])
    n, r = cat.scan("wh", "nation"), cat.scan("wh", "region")
    joined = n.join(r, n.n_regionkey == r.r_regionkey)
    sinks.create_table(joined.select("n_name", "r_name"), cat, "derived", "nr",
                       path=os.path.join(tmp, "nr"))
    assert cat.scan("derived", "nr").count() == 25


def test_bucketed_materialise_joins_without_shuffle(spark, tmp):
    from conftest import plan
    cat = Catalog(spark)
    cat.register("wh", "parquet", files=[f"{SF}/orders.parquet", f"{SF}/lineitem.parquet"])
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        sinks.materialise(cat.scan("wh", t), os.path.join(tmp, t), catalog=cat,
                          connection="wh", table=t, bucket_by=(4, [key]))
    o, li = cat.scan("wh", "orders"), cat.scan("wh", "lineitem")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = li.join(o, li.l_orderkey == o.o_orderkey)
        p = plan(j)
        assert "SortMergeJoin" in p and "Exchange" not in p
        assert j.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
