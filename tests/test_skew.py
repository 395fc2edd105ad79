"""A key holding a third of the rows: the worksheet join is split by AQE's
skew handling (enabled by the session settings), not run as one hot task."""

from pyspark.sql import functions as F

from conftest import SF01
from vantage.catalog import Catalog
from vantage.plans.worksheet import Worksheet


def test_hot_key_join_is_split(spark, tmp):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    hot = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1))
                       .otherwise(F.col("o_custkey")))
    path = f"{tmp}/orders_hot"
    hot.repartition(8).write.parquet(path)
    cat = Catalog(spark)
    cat.register("wh", "parquet", files=[f"{SF01}/customer.parquet", path])
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # small thresholds stand in for 256 MB partitions at scale; the payload
        # columns keep the hot partition from compressing to nothing
        df = Worksheet(cat).run(
            "SELECT c.c_mktsegment, COUNT(*) AS n, SUM(o.o_totalprice) AS t, "
            "MAX(o.o_orderdate) AS d, SUM(o.o_orderkey) AS k FROM orders_hot o JOIN customer c "
            "ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")
        total = sum(r.n for r in df.collect())
        final = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert total == o.count()
    assert "skew=true" in final
