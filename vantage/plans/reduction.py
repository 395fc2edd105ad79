"""Runtime key reduction (W2): the keys of a join's filtered side as a condition on the other
side's scan, so that a database sends the rows that can match and not the whole table.

``key_condition`` evaluates the filtered side's distinct keys once: up to ``VALUES`` of them become an
``IN`` list; more become at most ``RANGES`` intervals (one per range partition of the keys, from one
aggregate), of a size that does not grow with the keys. The join itself stays as it is: the condition only drops rows
without a partner, so it is for the sides of an inner or semi join, or the optional side of an outer join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.operators.shaping import ref

VALUES, RANGES = 1000, 64
_LISTED = (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
_RANGED = (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)


def key_condition(keys: DataFrame, column: str, values: int = VALUES, ranges: int = RANGES) -> Column | None:
    """A condition on ``column`` that holds for every row whose value is among ``keys`` (one column); None if the
    keys have a type that a database may compare otherwise than Spark."""
    (name,), kind = keys.columns, keys.schema.fields[0].dataType
    if not isinstance(kind, _LISTED):
        return None
    distinct = keys.select(ref(name).alias("k")).where("k IS NOT NULL").distinct()
    some = [r.k for r in distinct.limit(values + 1).collect()]
    if len(some) <= values:
        return ref(column).isin(sorted(some)) if some else F.lit(False)
    if not isinstance(kind, _RANGED):
        return None  # a collation may order texts in another way
    dealt = distinct.repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("p"))
    spans = sorted((r.lo, r.hi) for r in dealt.agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect())  # ``ranges`` rows
    return reduce(lambda a, b: a | b, ((ref(column) >= F.lit(lo)) & (ref(column) <= F.lit(hi)) for lo, hi in spans))


def reduced(scan: DataFrame, column: str, keys: DataFrame, values: int = VALUES, ranges: int = RANGES) -> DataFrame:
    """The scan's rows that can find a partner among ``keys`` (one column)."""
    condition = key_condition(keys, column, values, ranges)
    return scan if condition is None else scan.where(condition)
