"""Bucketed copies whose hot keys are spread (K1).

A key with a third of a table's rows fills one bucket, and a join of bucketed copies has no shuffle that AQE could
split. ``materialise_pair`` finds such keys with a mergeable sketch (Spark's ``approx_top_k``, one row a task),
counts the few that it names exactly, and adds a salt to the bucketing: a hot key's rows of the large side are dealt
over as many salts as they fill buckets, its rows of the other side are repeated for each, and
every other row has salt 0. Both copies are bucketed by (key, salt), so their join reads even
buckets and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.operators import sinks
from vantage.operators.shaping import ref

SALT = "__salt"
TRACKED = 100_000  # of the sketch: counts are off by at most a 1 / 35,000th of the rows


def hot_keys(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``key, n, salts`` of the keys that have more than half a bucket's even share of the rows (fewer
    than ``2 * buckets`` of them), with exact counts."""
    total = df.count()
    most = min(2 * buckets, TRACKED // 2)
    named = df.where(ref(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED})").alias("top"))
    keys = named.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key))
    even = max(1.0, total / buckets)
    counts = df.join(F.broadcast(keys), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > even / 2).withColumn("salts", F.ceil(F.col("n") / F.lit(even)).cast("int"))


def salted(large: DataFrame, other: DataFrame, key: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``SALT``: join them on (key, SALT) for the pairs of a join on the key."""
    if SALT in large.columns or SALT in other.columns:
        raise ValueError(f"column {SALT} is reserved")
    hot = F.broadcast(hot_keys(large, key, buckets).where("salts > 1").select(key, "salts"))
    lot = F.xxhash64(*(ref(c) for c in large.columns if c != key and large.schema[c].dataType.simpleString() not in ("variant",)
                       and "map<" not in large.schema[c].dataType.simpleString()))
    dealt = F.pmod(F.xxhash64(lot, F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1))).cast("int")
    left = large.join(hot, key, "left").withColumn(SALT, dealt).select(*large.columns, SALT)
    right = (other.join(hot, key, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
             .select(*other.columns, SALT))
    return left, right


def materialise_pair(large: DataFrame, other: DataFrame, key: str, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Bucketed copies of both sides; ``join_pair`` joins them. For inner, left outer, semi and anti joins with
    ``large`` at the left: repeated rows of the other side would show in an outer join of it."""
    n = buckets or max(sinks.buckets_for(large), sinks.buckets_for(other))
    sides = salted(large, other, key, n)
    return tuple(sinks.materialise(s, table=f"salted_{name}", bucket_by=(n, [key, SALT])) for s, name in zip(sides, ("large", "other")))


def join_pair(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("inner, left, left_semi or left_anti")
    return left.join(right.hint("merge"), [key, SALT], how).drop(SALT)


def rows_by_bucket(df: DataFrame) -> list[int]:
    """Rows of each bucket of a bucketed copy (by its files' names), largest first."""
    sizes = df.groupBy(F.regexp_extract("_metadata.file_name", r"_(\d+)\.c\d+", 1).alias("bucket")).count().collect()
    return sorted((r["count"] for r in sizes), reverse=True)

