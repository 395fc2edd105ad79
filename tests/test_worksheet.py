import pytest

from conftest import SF, rows
from vantage.catalog import Catalog
from vantage.plans.worksheet import AmbiguousTable, ReadOnlyViolation, Worksheet, check_read_only

STATEMENTS = {
    "SELECT 1": True,
    "WITH a AS (SELECT 1 x) SELECT * FROM a": True,
    "VALUES (1)": True,
    "TABLE t": True,
    "SELECT 1 UNION SELECT 2": True,
    "SELECT /*+ BROADCAST(a) */ * FROM a": True,
    "DESCRIBE TABLE t": True,
    "SHOW TABLES": True,
    "EXPLAIN SELECT 1": True,
    "EXPLAIN DROP TABLE a": True,  # prints a plan, runs nothing
    "INSERT INTO t VALUES (1)": False,
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a": False,
    "FROM a INSERT INTO t SELECT * INSERT INTO u SELECT *": False,
    "DROP TABLE t": False,
    "CREATE VIEW v AS SELECT 1": False,
    "CREATE TABLE t AS SELECT 1": False,
    "SET spark.sql.x=1": False,
    "CACHE TABLE t": False,
    "TRUNCATE TABLE t": False,
    "DELETE FROM t WHERE a=1": False,
    "UPDATE t SET a=1": False,
    "MERGE INTO t USING s ON t.a=s.a WHEN MATCHED THEN DELETE": False,
    "BEGIN SELECT 1; END": False,
    "CALL cat.sys.proc()": False,
    "EXECUTE IMMEDIATE 'DROP TABLE t'": False,
    "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT 1": False,
    "SELECT 1; DROP TABLE t": False,
    "SELECT TOP 10 * FROM t": False,  # T-SQL is not Spark SQL
    "ADD JAR /tmp/x.jar": False,
    "CREATE TEMPORARY FUNCTION f AS 'x'": False,
    "ALTER TABLE t ADD COLUMNS (b INT)": False,
    "USE db": False,
    "DECLARE VARIABLE v INT": False,
    "SELECT reflect('java.lang.System', 'exit', 0)": False,
    "SELECT a FROM t WHERE java_method('java.util.UUID', 'randomUUID') IS NOT NULL": False,
    "SELECT reflected FROM t": True,
    "SELECT " + ", ".join(f"{i} AS c{i}" for i in range(40)) + ", reflect('a.B', 'c') FROM t": False,
    "SELECT system.builtin.reflect('a.B', 'c')": False,
    "SELECT `REFLECT` ('a.B', 'c')": False,
    "SELECT IDENTIFIER('ref' || 'lect')('a.B', 'c')": False,
    "WITH x AS (SELECT java_method('a.B', 'c')) SELECT * FROM x": False,
    "SELECT * FROM csv.`/etc/passwd`": False,
    "SELECT * FROM (SELECT * FROM parquet.`s3a://b/x`)": False,
}


def test_guard_table(spark):
    got = {q: check_read_only(spark, q) for q in STATEMENTS}
    assert got == STATEMENTS


@pytest.fixture()
def two(spark):
    """Two connections with a table of the same name and different rows."""
    cat = Catalog(spark)
    cat.register("a", "parquet", files=[f"{SF}/nation.parquet", f"{SF}/region.parquet"])
    cat.register("b", "parquet", files=[f"{SF}/region.parquet"], root=None)
    return cat


def test_same_name_tables_get_own_views(spark, two):
    ws = Worksheet(two)
    q = "SELECT COUNT(*) AS n FROM a__region x JOIN b__region y ON x.r_regionkey = y.r_regionkey"
    assert ws.run(q).collect()[0].n == 5
    # the bare name is ambiguous: an error, whatever view another worksheet left
    with pytest.raises(AmbiguousTable):
        ws.run("SELECT * FROM region")
    assert ws.run("WITH region AS (SELECT 1 AS x) SELECT * FROM region").collect()[0].x == 1
    assert ws.resolve("SELECT * FROM nation n JOIN b__region r ON 1=1") == [
        ("a", "nation"), ("b", "region")]


def test_cross_connection_join(spark, two):
    ws = Worksheet(two)
    df = ws.run("SELECT r_name, COUNT(*) AS n FROM nation JOIN b__region "
                "ON n_regionkey = r_regionkey GROUP BY r_name")
    assert sum(r.n for r in df.collect()) == 25


def test_guard_blocks_before_running(spark, two):
    ws = Worksheet(two)
    with pytest.raises(ReadOnlyViolation):
        ws.run("CREATE TABLE vantage_should_not_exist AS SELECT 1")
    assert not spark.catalog.tableExists("vantage_should_not_exist")


def test_run_safe_errors(spark, two):
    ws = Worksheet(two)
    df, err = ws.run_safe("SELECT nope FROM nation")
    assert df is None and "nope" in err
    df, err = ws.run_safe("DROP TABLE nation")
    assert df is None and "read-only" in err
    df, err = ws.run_safe("SELECT COUNT(*) AS n FROM nation")
    assert err is None and df.collect()[0].n == 25


def test_names_resolve_without_case(spark, two):
    ws = Worksheet(two)
    assert ws.resolve("SELECT * FROM Nation JOIN B__REGION ON 1=1") == [
        ("a", "nation"), ("b", "region")]
    assert ws.run("SELECT COUNT(*) AS n FROM NATION").collect()[0].n == 25


def test_inner_relations_are_found(spark, two):
    for v in spark.catalog.listTables():
        if v.isTemporary:
            spark.catalog.dropTempView(v.name)
    ws = Worksheet(two)
    assert ws.run("WITH x AS (SELECT * FROM nation) SELECT COUNT(*) AS n FROM x").collect()[0].n == 25
    assert [r.col_name for r in ws.run("DESCRIBE nation").collect()] == ["n_nationkey", "n_name", "n_regionkey"]
    spark.catalog.dropTempView("nation")
    assert "Parquet" in ws.run("EXPLAIN SELECT * FROM nation").collect()[0].plan


def test_views_of_another_catalog_do_not_answer(spark, two):
    Worksheet(two).run("SELECT * FROM nation")
    other = Catalog(spark)
    other.register("c", "parquet", files=[f"{SF}/region.parquet"])
    df, err = Worksheet(other).run_safe("SELECT * FROM nation")
    assert df is None and "nation" in err


def test_every_worksheet_query_runs_on_an_empty_view_list(spark):
    from vantage.plans.registry import QUERIES
    for name in [n for n in QUERIES if n.startswith("ws_")]:
        for v in spark.catalog.listTables():
            if v.isTemporary:
                spark.catalog.dropTempView(v.name)
        QUERIES[name](spark, SF).schema


def test_no_parser_no_run(two):
    class Remote:
        pass
    assert check_read_only(Remote(), "SELECT 1") is False
