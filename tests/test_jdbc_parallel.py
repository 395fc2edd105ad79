"""S4 / S9 splits of equal depth and K5 appends that happen once, on an embedded Derby."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from vantage.catalog import Catalog
from vantage.sources import jdbc, jdbc_append, splits


@pytest.fixture(scope="module")
def db(spark):
    cat = Catalog(spark)
    cat.register("par", "jdbc", url="jdbc:derby:memory:vantage_parallel;create=true",
                 driver="org.apache.derby.jdbc.EmbeddedDriver", schema="APP", preferTimestampNTZ="true",
                 partitions={t: {"column": c, "num": 8} for t, c in (
                     ("DENSE", "k"), ("TEXTS", "name"), ("DAYS", "day"), ("HOT", "k"), ("NULLS", "k"))} | {"FREE": {"num": 6}, "BARE": {"num": 6}})
    return cat


def put(db, table, df, types=None):
    jdbc.append(df, db.connection("par"), table, once=False, column_types=types)
    return db.scan("par", table)


def sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_a_dense_key_is_read_evenly(spark, db):
    # nine of ten rows in a hundredth of the range
    k = F.when(F.col("id") % 10 < 9, F.col("id") % 1000).otherwise(F.col("id") * 100)
    src = spark.range(1000).select(k.alias("k"), (F.col("id") * 2).alias("v"))
    got = put(db, "DENSE", src)
    assert rows(got) == rows(src)
    assert len(sizes(got)) == 8 and max(sizes(got)) <= 130 and min(sizes(got)) >= 120
    equal = jdbc.read_table(spark, db.connection("par"), "DENSE", lower_bound=0, upper_bound=100_000)
    assert max(sizes(equal)) > 900  # equal ranges: what it replaces


def test_text_and_date_keys(spark, db):
    src = spark.range(400).select(F.concat(F.lit("it's "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"))
    got = put(db, "TEXTS", src, "name VARCHAR(20)")
    assert rows(got) == rows(src) and sizes(got) == [50] * 8
    days = spark.range(400).select(F.expr("date_add(DATE'2020-01-01', CAST(id AS INT))").alias("day"))
    got = put(db, "DAYS", days)
    assert rows(got) == rows(days) and sizes(got) == [50] * 8


def test_a_hot_value_and_nulls(spark, db):
    hot = spark.range(800).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"))
    got = put(db, "HOT", hot)
    assert rows(got) == rows(hot) and max(sizes(got)) == 400 and len(sizes(got)) == 5
    nulls = spark.range(80).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    got = put(db, "NULLS", nulls)
    assert sorted(r.v for r in got.collect()) == list(range(80)) and max(sizes(got)) == 60


def test_without_a_named_column(spark, db):
    src = spark.range(600).select((F.col("id") % 2).alias("flag"), F.col("id").alias("k"), F.lit(1.5).alias("x"))
    got = put(db, "FREE", src)  # flag splits badly, k evenly
    assert rows(got) == rows(src) and sizes(got) == [100] * 6
    one = spark.range(5).select(F.col("id").cast("double").alias("x"))
    assert put(db, "BARE", one).rdd.getNumPartitions() == 1


def test_filters_are_still_pushed(db, spark):
    from conftest import plan
    assert "GreaterThan(v,1000)" in plan(db.scan("par", "DENSE").where("v > 1000"))


def test_literals_and_predicates():
    assert [splits.literal(v) for v in (5, decimal.Decimal("1.5"), "o'k", dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5, 6))] == [
        "5", "1.5", "'o''k'", "{d '2020-01-02'}", "{ts '2020-01-02 03:04:05.000006'}"]
    assert splits.predicates("k", [], 0) == [] and splits.predicates("k", [3, 3, 9], 1) == [
        '"k" < 3', '"k" >= 3 AND "k" < 9', '"k" >= 9', '"k" IS NULL']


def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice").repartition(5)


def test_append_once(spark, db):
    conn, o = db.connection("par"), orders(spark)
    assert jdbc.append(o, conn, "ONCE", job="load-1")
    assert rows(db.scan("par", "ONCE")) == rows(o)
    assert not jdbc.append(o, conn, "ONCE", job="load-1")  # a rerun of the same job
    assert db.scan("par", "ONCE").count() == o.count()
    assert jdbc.append(o, conn, "ONCE", job="load-2")
    assert db.scan("par", "ONCE").count() == 2 * o.count()
    assert not [t for t in jdbc.table_names(spark, conn) if t.upper().startswith("ONCE_")]  # no staging table stays


def test_a_task_that_runs_again_after_its_commit(spark, db):
    conn, o = db.connection("par"), orders(spark)
    opts = jdbc.base_options(conn)
    jdbc.append(o.limit(0), conn, "AGAIN", job="shape")
    o.limit(0).withColumn("__part", F.lit(0)).withColumn("__attempt", F.lit(0).cast("long")).write.format("jdbc").options(
        **opts, dbtable="APP.AGAIN_S").mode("append").save()
    jdbc_append.stage(o, opts, "APP.AGAIN_S")
    one = spark.read.format("jdbc").options(**opts, dbtable="APP.AGAIN_S").load().where("__part = 2")
    extra = one.withColumn("__attempt", F.col("__attempt") + 1000)
    kept = extra.collect()
    for some in (kept, kept[:7]):  # the whole attempt once more, and a torn one
        again = spark.createDataFrame(some, extra.schema).withColumn("__attempt", F.col("__attempt") + len(some))
        again.write.format("jdbc").options(**opts, dbtable="APP.AGAIN_S").mode("append").save()
    merge = lambda job, n: jdbc_append.merge(spark, opts, "APP.AGAIN", "APP.AGAIN_S", "APP.vantage_appends", job, o.columns, n)
    with pytest.raises(RuntimeError):
        merge("again", o.count() + 1)
    assert db.scan("par", "AGAIN").count() == 0
    assert merge("again", o.count()) and not merge("again", o.count())
    assert rows(db.scan("par", "AGAIN")) == rows(o)


def test_a_call_that_dies_changes_nothing(spark, db, monkeypatch):
    conn, o = db.connection("par"), orders(spark)
    jdbc.append(o, conn, "DIES", job="dies-0")

    def dies(*_, **__):
        raise RuntimeError("lost")
    monkeypatch.setattr(jdbc_append, "merge", dies)
    with pytest.raises(RuntimeError):
        jdbc.append(o, conn, "DIES", job="dies-1")
    assert db.scan("par", "DIES").count() == o.count()
    monkeypatch.undo()
    assert jdbc.append(o, conn, "DIES", job="dies-1")
    assert db.scan("par", "DIES").count() == 2 * o.count()
