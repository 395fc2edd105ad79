import json
import os
import zipfile

import pytest

from conftest import SF, rows
from vantage.catalog import Catalog
from vantage.sources import jdbc

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RNS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_csv_quotes(spark, tmp):
    path = os.path.join(tmp, "q.csv")
    with open(path, "w") as f:
        f.write('id,name,amt\n1,"Smith, J",10\n2,"say ""hi""",\n3,,7.5\n')
    cat = Catalog(spark)
    cat.register("files", "csv", files=[path])
    df = cat.scan("files", "q")
    assert df.dtypes == [("id", "string"), ("name", "string"), ("amt", "string")]
    assert rows(df) == [("1", "Smith, J", "10"), ("2", 'say "hi"', None), ("3", None, "7.5")]
    typed = cat.scan("files", "q", schema="id int, name string, amt double")
    assert rows(typed, "id", "amt") == [(1, 10.0), (2, None), (3, 7.5)]


def test_json_file_and_payload(spark, tmp):
    doc = [{"id": 1, "u": {"n": "a", "g": {"lat": 1.5}}, "tags": ["x"]}, {"id": 2, "tags": []}]
    os.makedirs(os.path.join(tmp, "api"))
    with open(os.path.join(tmp, "api", "p1.json"), "w") as f:
        json.dump(doc, f, indent=2)
    with open(os.path.join(tmp, "api", "p2.json"), "w") as f:
        json.dump({"id": 3, "u": {"n": "c"}}, f, indent=2)
    cat = Catalog(spark)
    cat.register("web", "api", files=[os.path.join(tmp, "api")])
    df = cat.scan("web", "api")
    assert df.columns == ["id", "tags", "u_g", "u_n"]
    assert rows(df, "id", "u_n") == [(1, "a"), (2, None), (3, "c")]
    lines = os.path.join(tmp, "lines.json")
    with open(lines, "w") as f:
        f.write('{"a.b": 1, "Time Series (Daily)": {"x": 2}}\n')
    cat.register("files", "json", files=[lines])
    flat = cat.scan("files", "lines", flatten=True)
    assert flat.columns == ["Time Series (Daily)_x", "a.b"]
    assert flat.collect()[0][0] == 2


@pytest.fixture(scope="module")
def derby(spark):
    cat = Catalog(spark)
    cat.register("db", "jdbc", url="jdbc:derby:memory:vantage_tests;create=true",
                 driver="org.apache.derby.jdbc.EmbeddedDriver", schema="APP",
                 preferTimestampNTZ="true",
                 partitions={"ORDERS": {"column": "o_orderkey", "num": 4}})
    o = spark.read.parquet(f"{SF}/orders.parquet")
    jdbc.append(o, cat.connection("db"), "ORDERS", once=False,
                column_types="o_orderstatus VARCHAR(1), o_orderpriority VARCHAR(20)")
    return cat


def test_jdbc_roundtrip_partitioned(spark, derby):
    df = derby.scan("db", "ORDERS")
    assert df.rdd.getNumPartitions() == 4
    src = spark.read.parquet(f"{SF}/orders.parquet")
    shape = lambda sch: [(f.name, f.dataType, f.nullable) for f in sch]
    assert shape(df.schema) == shape(src.schema)  # JDBC adds column metadata only
    assert df.exceptAll(src).count() == 0 and src.exceptAll(df).count() == 0


def test_jdbc_listing_and_pushdown(spark, derby):
    assert [r.table for r in derby.tables().collect()] == ["ORDERS"]
    cols = derby.columns().orderBy("position").collect()
    assert [c.column_name for c in cols][:2] == ["o_orderkey", "o_custkey"]
    from conftest import plan
    p = plan(derby.scan("db", "ORDERS").filter("o_orderstatus = 'F'"))
    assert "EqualTo(o_orderstatus,F)" in p


def test_jdbc_options_builders():
    from vantage.catalog import Connection
    ss = Connection("ss", "sqlserver", {"server": "h", "database": "d", "schema": "dbo",
                                        "user": "u", "password": "env:VANTAGE_TEST_PW"})
    os.environ["VANTAGE_TEST_PW"] = "pw"
    opts = jdbc.base_options(ss)
    assert opts["url"].startswith("jdbc:sqlserver://h;databaseName=d;encrypt=true")
    assert opts["password"] == "pw" and opts["driver"].endswith("SQLServerDriver")
    sf = Connection("sf", "snowflake", {"account": "acc", "database": "D", "schema": "S",
                                        "warehouse": "W", "role": "R"})
    assert jdbc.url_of(sf) == "jdbc:snowflake://acc.snowflakecomputing.com/?db=D&schema=S&warehouse=W&role=R"
    assert jdbc.qualified(sf, "T") == "D.S.T"
    sfc = Connection("sfc", "snowflake", {"account": "acc", "database": "D", "schema": "S",
                                          "user": "u", "connector": "spark"})
    assert jdbc.snowflake_connector_options(sfc, "T") == {
        "sfURL": "acc.snowflakecomputing.com", "sfDatabase": "D", "sfSchema": "S",
        "dbtable": "T", "sfUser": "u"}
    pg = Connection("pg", "postgres", {"host": "h", "database": "d"})
    assert jdbc.url_of(pg) == "jdbc:postgresql://h:5432/d"
    assert "INFORMATION_SCHEMA.COLUMNS" in jdbc._columns_sql(pg)


def test_todo_list_payload(spark, tmp):
    """An API that returns a JSON array of flat records (our own guess at a
    todo-list payload): one row per element, types inferred."""
    folder = os.path.join(tmp, "todos")
    os.makedirs(folder)
    items = [{"userId": 1, "id": i, "title": f"task {i}", "completed": i % 2 == 0}
             for i in range(1, 6)]
    with open(os.path.join(folder, "page1.json"), "w") as f:
        json.dump(items, f)
    cat = Catalog(spark)
    cat.register("todo_api", "api", files=[folder])
    df = cat.scan("todo_api", "todos")
    assert dict(df.dtypes) == {"completed": "boolean", "id": "bigint", "title": "string",
                               "userId": "bigint"}
    assert df.filter("completed").count() == 2


def test_jdbc_diagnose_and_counts(spark, derby):
    from vantage.catalog import with_row_counts
    from vantage.operators.health import diagnose
    got = {(r.table, r.ok, r.n_rows) for r in diagnose(derby, mode="read").collect()}
    assert got == {("ORDERS", True, 1500)}
    assert [(r.table, r.n_rows) for r in with_row_counts(spark, derby).collect()] == [
        ("ORDERS", 1500)]
