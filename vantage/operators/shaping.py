"""Shaping: null-token fill (T1), struct flatten (T2), projection (T3), sort (T4),
any-column search (T5), preview (T6), calculated columns (T7), structure (C7).

All are single narrow transformations except ``sort`` (a range shuffle, or a
top-k when followed by a limit) and ``structure(..., profile=True)`` (one
aggregate pass with partial aggregation per task).
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.operators.predicates import NULL_TOKEN


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    return F.col(quote(name))


# -- T1 ---------------------------------------------------------------------------

def fill_null_token(df: DataFrame, token: str = NULL_TOKEN,
                    columns: Sequence[str] | None = None) -> DataFrame:
    """Null string cells read as ``token``; other types keep their nulls."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    wanted = strings if columns is None else strings & set(columns)
    return df.select(*[
        F.coalesce(ref(c), F.lit(token)).alias(c) if c in wanted else ref(c)
        for c in df.columns])


# -- T2 ---------------------------------------------------------------------------

class NameClash(ValueError):
    pass


def flatten(df: DataFrame, depth: int | None = 1, sep: str = "_",
            on_clash: str = "raise") -> DataFrame:
    """Struct fields become ``parent{sep}child`` columns, schema order kept.

    ``depth=1`` flattens one level (arrays, maps and deeper structs stay);
    ``depth=None`` flattens every struct level. Names with dots or spaces are
    quoted. A produced name equal to another column raises (``on_clash='raise'``)
    or gets a numeric suffix (``'suffix'``).
    """
    cols: list[tuple[str, Column]] = []

    def walk(prefix: str, expr: Column, dtype, level: int):
        if isinstance(dtype, T.StructType) and (depth is None or level < depth):
            for f in dtype.fields:
                walk(f"{prefix}{sep}{f.name}", expr.getField(f.name), f.dataType, level + 1)
        else:
            cols.append((prefix, expr))

    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType) and (depth is None or depth > 0):
            for sub in f.dataType.fields:
                walk(f"{f.name}{sep}{sub.name}", ref(f.name).getField(sub.name),
                     sub.dataType, 1)
        else:
            cols.append((f.name, ref(f.name)))

    seen: dict[str, int] = {}
    out = []
    for name, expr in cols:
        if name in seen:
            if on_clash == "raise":
                raise NameClash(f"flattened name {name!r} occurs twice")
            seen[name] += 1
            new = f"{name}{sep}{seen[name]}"
            while new in seen:
                seen[name] += 1
                new = f"{name}{sep}{seen[name]}"
            name = new
        seen.setdefault(name, 1)
        out.append(expr.alias(name))
    return df.select(*out)


# -- T3 / T4 / T5 / T6 ----------------------------------------------------------------

def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the chosen columns, in the given order (pruned at the scan)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}; columns are {df.columns}")
    return df.select(*[ref(c) for c in columns])


def sort(df: DataFrame, keys: Iterable, nulls: str = "first") -> DataFrame:
    """``keys``: names or ``(name, 'asc'|'desc')``. Null placement is explicit:
    ``nulls='first'`` puts nulls first for ascending keys and last for
    descending ones (Spark's default), ``'last'`` the reverse."""
    order = []
    for k in keys:
        name, direction = (k, "asc") if isinstance(k, str) else k
        c = ref(name)
        asc = direction.lower().startswith("asc")
        nulls_first = (nulls == "first") == asc
        if asc:
            order.append(c.asc_nulls_first() if nulls_first else c.asc_nulls_last())
        else:
            order.append(c.desc_nulls_first() if nulls_first else c.desc_nulls_last())
    return df.orderBy(*order)


def search(df: DataFrame, text: str, columns: Sequence[str] | None = None,
           case_sensitive: bool = False) -> DataFrame:
    """Rows where any chosen column's text contains ``text`` (literal match)."""
    text = str(text)
    if not text:
        return df
    names = list(columns) if columns is not None else df.columns
    needle = text if case_sensitive else text.lower()
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in names if _may_contain(types[n], needle, case_sensitive)]
    if not names:
        return df.limit(0)
    conds = []
    for name in names:
        c = ref(name).cast("string")
        if not case_sensitive:
            c = F.lower(c)
        conds.append(c.contains(needle))
    return df.filter(reduce(lambda a, b: a | b, conds))


_NUMERIC_TEXT = set("0123456789.-+E")
_NUMERIC_WORDS = ("NaN", "Infinity", "-Infinity")


def _may_contain(dtype, needle: str, case_sensitive: bool) -> bool:
    """False when the text of every value of ``dtype`` provably cannot contain
    ``needle`` (numbers are digits, sign, point and exponent; booleans are
    true/false), so the column can be left out of the OR."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType,
                          T.FloatType, T.DecimalType)):
        n = needle if case_sensitive else needle.upper()
        if set(n) <= _NUMERIC_TEXT:
            return True
        words = _NUMERIC_WORDS if case_sensitive else [w.upper() for w in _NUMERIC_WORDS]
        return any(n in w for w in words)
    if isinstance(dtype, T.BooleanType):
        n = needle if case_sensitive else needle.lower()
        return n in "true" or n in "false"
    return True


def preview(df: DataFrame, n: int = 100, order: Iterable | None = None) -> DataFrame:
    """First ``n`` rows; with ``order`` this is a top-k (no full sort)."""
    if order is not None:
        df = sort(df, order)
    return df.limit(n)


def collect_preview(df: DataFrame, n: int = 100, order: Iterable | None = None):
    """The one driver-side action: ``n`` rows for display."""
    return preview(df, n, order).collect()


# -- T7 ---------------------------------------------------------------------------------

def add_columns(df: DataFrame, exprs: Mapping[str, str | Column]) -> DataFrame:
    """Calculated columns from SQL expression text or Columns (one Project)."""
    return df.withColumns({k: (F.expr(v) if isinstance(v, str) else v)
                           for k, v in exprs.items()})


# -- C7 ---------------------------------------------------------------------------------

STRUCTURE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("nullable", T.BooleanType(), False),
])


def structure(df: DataFrame, profile: bool = False) -> DataFrame:
    """One row per column: position, name, type text, nullable.

    ``profile=True`` adds ``n_rows`` and ``non_null`` per column, from ONE
    aggregate over the table (partial counts per task, one tiny shuffle), then
    unpivoted in place; the output has one row per column whatever the data size.
    """
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), bool(f.nullable))
         for i, f in enumerate(df.schema.fields, start=1)], STRUCTURE_SCHEMA)
    if not profile or not df.columns:
        return meta if not profile else meta.withColumns(
            {"n_rows": F.lit(None).cast("bigint"), "non_null": F.lit(None).cast("bigint")})
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count(ref(c)).alias(f"__c{i}") for i, c in enumerate(df.columns, start=1)]
    counts = df.agg(*aggs)  # one row: partial counts per task, one tiny exchange
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"),
                 F.lit(bool(f.nullable)).alias("nullable"),
                 F.col("__n").cast("bigint").alias("n_rows"),
                 F.col(f"__c{i}").cast("bigint").alias("non_null"))
        for i, f in enumerate(df.schema.fields, start=1)])
    # unpivot the single row in place: no join, nothing broadcast
    return counts.select(F.inline(rows))
