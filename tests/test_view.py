import os

from conftest import SF, plan
from vantage.catalog import Catalog
from vantage.operators.predicates import FilterSpec
from vantage.operators.view import View


def test_view_compiles_to_one_plan(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    v = (View(o).filter(FilterSpec("equal", "o_orderstatus", "F", id="s"))
         .filter(FilterSpec("starts with", "o_orderpriority", "1-", id="p"))
         .select(["o_orderkey", "o_orderpriority", "o_totalprice"])
         .sort(("o_totalprice", "desc"), "o_orderkey"))
    top = v.preview(10)
    p = plan(top)
    assert "TakeOrderedAndProject" in p and "EqualTo(o_orderstatus,F)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double," \
           "o_orderpriority:string>" in p
    want = (o.filter("o_orderstatus = 'F' AND o_orderpriority LIKE '1-%'")
            .orderBy(o.o_totalprice.desc(), "o_orderkey").limit(10)
            .select("o_orderkey", "o_orderpriority", "o_totalprice").collect())
    assert top.collect() == want
    assert v.unfilter("p").frame().count() == o.filter("o_orderstatus = 'F'").count()
    assert v.search("1-URG").frame().count() == v.frame().filter(
        "o_orderpriority LIKE '%1-URG%'").count()


def test_catalog_from_yaml(spark, tmp):
    path = os.path.join(tmp, "settings.yaml")
    with open(path, "w") as f:
        f.write(f"wh:\n  name: wh\n  source: parquet\n  root: {SF}\n"
                "  files: [nation.parquet, region.parquet]\n")
    cat = Catalog.from_yaml(spark, path)
    assert cat.table_names("wh") == ["nation", "region"]


def test_catalog_view_and_worksheet_save(spark, tmp):
    from vantage.plans.worksheet import Worksheet
    cat = Catalog(spark)
    cat.register("wh", "parquet", files=[f"{SF}/nation.parquet", f"{SF}/region.parquet"])
    v = cat.view("wh", "nation").filter(FilterSpec("equal", "n_regionkey", "1"))
    assert v.frame().count() == 5
    assert [r.column_name for r in v.structure().collect()] == ["n_nationkey", "n_name",
                                                                 "n_regionkey"]
    exported = v.export(os.path.join(tmp, "view_csv"), fmt="csv")
    assert spark.read.option("header", True).csv(exported).count() == 5
    out = os.path.join(tmp, "result")
    Worksheet(cat).save("SELECT r_name, COUNT(*) AS n FROM nation JOIN region "
                        "ON n_regionkey = r_regionkey GROUP BY r_name", out)
    back = spark.read.schema("r_name STRING, n BIGINT").option("header", True).csv(out)
    assert sorted((r.r_name, r.n) for r in back.collect())[0][1] == 5
