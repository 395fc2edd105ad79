"""Equal-depth splits of a database table for parallel reads.

Equal ranges between a key's least and greatest value leave most rows in one task when the
key is dense in one place. Here the database gives the split points: one query numbers the keys in order
and returns every ``rows / tasks``-th. The splits are predicates (``key < a``, ``key >= a AND key < b``, ...,
``key IS NULL`` where there are nulls), which the database compares as it ordered them, so they cover each row
once for numbers, dates and texts of any collation alike. A value that takes several splits gets one of its own.

Without a named key the table's declared keys are tried, then its columns by type; the first whose
splits are even is taken. Only a table without any column that has an order is read by one task.
"""

from __future__ import annotations

import datetime as dt
import decimal
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROWS_PER_TASK, MOST_TASKS = 500_000, 1024
_ORDERED = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.StringType)


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(value) -> str:
    """An SQL literal; dates and times as JDBC escapes, which every driver translates."""
    if isinstance(value, bool) or value is None or isinstance(value, float):
        raise TypeError(f"no split point: {value!r}")
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return "{ts '" + value.strftime("%Y-%m-%d %H:%M:%S.%f") + "'}"
    if isinstance(value, dt.date):
        return "{d '" + value.isoformat() + "'}"
    return "'" + str(value).replace("'", "''") + "'"


def _rows(spark: SparkSession, options: dict, sql: str) -> list:
    opts = {k: v for k, v in options.items() if k != "dbtable"} | {"query": sql}
    return [tuple(r) for r in spark.read.format("jdbc").options(**opts).load().collect()]


def _is_derby(options: dict) -> bool:
    return options["url"].startswith("jdbc:derby")


def points(spark: SparkSession, options: dict, column: str, tasks: int | None = None) -> tuple[list, int, int]:
    """Split points of a column (at most ``MOST_TASKS`` values, by one query), and numbers of rows: with a key, without."""
    k, table = quote(column), options["dbtable"]
    ((n, total),) = _rows(spark, options, f"SELECT COUNT({k}) AS n, COUNT(*) AS total FROM {table}")
    tasks = min(MOST_TASKS, tasks or -(-n // ROWS_PER_TASK))
    at = sorted({1 + n * i // tasks for i in range(1, tasks)} - {1}) if n else []
    if not at:
        return [], n, total - n
    keys = f"SELECT {k} AS k FROM {table} WHERE {k} IS NOT NULL"
    if _is_derby(options):  # numbers rows as they come
        numbered = f"SELECT k, ROW_NUMBER() OVER () AS rn FROM ({keys} ORDER BY k) x"
    else:
        numbered = f"SELECT k, ROW_NUMBER() OVER (ORDER BY k) AS rn FROM ({keys}) x"
    found = _rows(spark, options, f"SELECT k FROM ({numbered}) y WHERE rn IN ({', '.join(map(str, at))})")
    return [r[0] for r in found], n, total - n


def predicates(column: str, found: list, nulls: int) -> list[str]:
    """Conditions that hold for each row exactly once. A point that occurs more than once is a value of
    that many tasks' rows: ``>= v AND < next`` then starts a split of its own."""
    k, cuts = quote(column), []
    for text in map(literal, sorted(found)):
        if not cuts or cuts[-1] != text:
            cuts.append(text)
    if not cuts:
        return [] if not nulls else [f"{k} IS NOT NULL", f"{k} IS NULL"]
    out = [f"{k} < {cuts[0]}", *(f"{k} >= {a} AND {k} < {b}" for a, b in zip(cuts, cuts[1:])), f"{k} >= {cuts[-1]}"]
    return out + ([f"{k} IS NULL"] if nulls else [])


def declared_keys(spark: SparkSession, conn, table: str, options: dict) -> list[str]:
    """First columns of the table's primary and unique keys, by the standard's catalog views; none
    where a database has no such views."""
    if _is_derby(options) or conn.source == "snowflake":
        return []
    schema = conn.options.get("schema", "")
    sql = ("SELECT k.COLUMN_NAME AS c, t.CONSTRAINT_TYPE AS y FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS t "
           "JOIN INFORMATION_SCHEMA.KEY_COLUMN_USAGE k ON k.CONSTRAINT_NAME = t.CONSTRAINT_NAME "
           "AND k.TABLE_SCHEMA = t.TABLE_SCHEMA AND k.TABLE_NAME = t.TABLE_NAME "
           f"WHERE t.TABLE_NAME = {literal(table)} AND t.TABLE_SCHEMA = {literal(schema)} "
           "AND k.ORDINAL_POSITION = 1 AND t.CONSTRAINT_TYPE IN ('PRIMARY KEY', 'UNIQUE')")
    return [c for c, _ in sorted(_rows(spark, options, sql), key=lambda r: r[1])]


def candidates(schema: T.StructType, declared: list[str]) -> list[str]:
    """Columns to split by, best first: declared keys, then by type in the order of ``_ORDERED``."""
    by_type = sorted((next(i for i, t in enumerate(_ORDERED) if isinstance(f.dataType, t)), at, f.name)
                     for at, f in enumerate(schema.fields) if isinstance(f.dataType, _ORDERED))
    return list(dict.fromkeys([*declared, *(name for _, _, name in by_type)]))


def read_split(spark: SparkSession, conn, table: str, options: dict, column: str | None, tasks: int | None) -> DataFrame:
    """The table read by equal-depth predicates on ``column``, or on the first column that splits it evenly (at
    most four are tried)."""
    plain = spark.read.format("jdbc").options(**options).load()
    names = [column] if column else candidates(plain.schema, declared_keys(spark, conn, table, options))[:4]
    best: list[str] = []
    for name in names:
        found, n, nulls = points(spark, options, name, tasks)
        cuts = predicates(name, found, nulls)
        if len(cuts) > len(best):
            best = cuts
        if len(set(map(str, found))) == len(found):
            break
    if len(best) < 2:
        if not names:
            logging.getLogger(__name__).warning("%s.%s is read by a single task: none of its columns has an order", conn.name, table)
        return plain
    props = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=best, properties=props)
