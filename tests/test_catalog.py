import pytest

from conftest import SF, rows
from vantage.catalog import Catalog, UnknownSource, UnknownTable, with_row_counts
from vantage.operators.health import diagnose

SPECS = {  # the YAML shape: {key: {name, source, ...}}; dummy values only
    "wh": {"name": "wh", "source": "parquet",
           "files": ["nation.parquet", "region.parquet"], "root": SF},
    "one": {"name": "one", "source": "parquet", "files": [f"{SF}/orders.parquet",
                                                          f"{SF}/customer.parquet"],
            "table": "orders"},
}


def test_from_specs_tables_and_columns(spark):
    cat = Catalog.from_specs(spark, SPECS)
    assert rows(cat.tables(), "connection", "table") == [
        ("one", "orders"), ("wh", "nation"), ("wh", "region")]
    cols = cat.columns().filter("table = 'nation'").orderBy("position")
    assert [(r.column_name, r.data_type) for r in cols.collect()] == [
        ("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]


def test_restricted_connection_scans_only_its_table(spark):
    cat = Catalog.from_specs(spark, SPECS)
    assert cat.table_names("one") == ["orders"]
    assert cat.scan("one", "orders").count() == 1500
    with pytest.raises(UnknownTable):
        cat.scan("one", "customer")


def test_exact_source_match():
    with pytest.raises(UnknownSource):
        Catalog(None).register("x", "sql")  # a substring of 'sqlserver' is not a source


def test_register_replaces(spark):
    cat = Catalog.from_specs(spark, SPECS)
    cat.register("wh", "parquet", files=[f"{SF}/part.parquet"])
    assert cat.table_names("wh") == ["part"]
    with pytest.raises(UnknownTable):
        cat.scan("wh", "nation")


def test_row_counts(spark):
    cat = Catalog.from_specs(spark, SPECS)
    got = rows(with_row_counts(spark, cat), "table", "n_rows")
    assert got == [("nation", 25), ("orders", 1500), ("region", 5)]


def test_diagnose(spark):
    cat = Catalog.from_specs(spark, SPECS)
    cat.register("bad", "csv", files=[f"{SF}/missing.csv"])
    schema = {(r.connection, r.table): (r.ok, r.message, r.n_rows)
              for r in diagnose(cat).collect()}
    assert schema[("bad", "missing")] == (False, "missing", None)
    assert schema[("wh", "nation")] == (True, "ok", None)
    read = {(r.connection, r.table): r.n_rows for r in diagnose(cat, mode="read").collect()}
    assert read[("wh", "region")] == 5 and read[("bad", "missing")] is None
    sample = {(r.connection, r.table): r.n_rows for r in diagnose(cat, mode="sample").collect()}
    assert sample[("wh", "region")] == 1 and sample[("bad", "missing")] is None


def test_registering_again_lists_new_files(spark, tmp):
    path = tmp + "/t"
    spark.range(5).write.parquet(path)
    cat = Catalog(spark)
    cat.register("u", "parquet", files=[path])
    assert cat.scan("u", "t").count() == 5
    spark.range(4).write.mode("append").parquet(path)
    cat.register("u", "parquet", files=[path])
    assert cat.scan("u", "t").count() == 9


def test_columns(spark):
    cat = Catalog.from_specs(spark, SPECS)
    got = [(r.table, r.position, r.column_name, r.data_type) for r in cat.columns().collect() if r.table == "region"]
    assert got == [("region", 1, "r_regionkey", "int"), ("region", 2, "r_name", "string")]


def test_footer_counts_of_odd_paths(spark, tmp):
    """Blanks and umlauts in paths, folders within folders, globs, an empty table, two connections to one file."""
    o = spark.read.parquet(f"{SF}/orders.parquet")
    for k, path in enumerate(("a b/tä%ble", "plain", "plain/inner", "zero")):
        o.where(f"o_orderkey <= {[10, 20, 30, -1][k]}").repartition(3).write.mode("append").parquet(f"{tmp}/{path}")
    cat = Catalog(spark)
    cat.register("x", "parquet", files=[f"{tmp}/a b/tä%ble", f"{tmp}/zero", f"{SF}/nation.parquet"])
    cat.register("y", "parquet", files=[f"{SF}/nation.parquet", f"{SF}/regio*.parquet"])
    cat.register("z", "parquet", files=[f"{tmp}/plain", f"{tmp}/plain/inner"])
    got = {(r.connection, r.table): r.n_rows for r in with_row_counts(spark, cat).collect()}
    keys = {k: o.where(f"o_orderkey <= {k}").count() for k in (10, 20, 30)}
    assert got == {("x", "tä%ble"): keys[10], ("x", "zero"): 0, ("x", "nation"): 25, ("y", "nation"): 25, ("y", "regio*"): 5,
                   ("z", "plain"): keys[20], ("z", "inner"): keys[30]}
