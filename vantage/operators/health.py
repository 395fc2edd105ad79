"""Source readiness check (C9): ``diagnose(catalog)`` -> one row per table,
``diagnose_files(catalog)`` -> one row per file.

``mode='schema'`` resolves each table's schema (file footers / JDBC metadata,
no data read). ``mode='sample'`` also reads one row of each table (cheap at any
size; ``n_rows`` is 0 or 1). ``mode='read'`` reads every column of every table:
files one by one (``fileprobe``), so a broken file makes its table ``ok = false``, with the
rows of its other files counted, and leaves the other tables alone; a database table is
counted by a query of its own. A table that does not resolve gives ``ok = false`` and a
short reason instead of raising.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.catalog import count_rows
from vantage.operators.fileprobe import PROBE, probe_files

DIAGNOSE_SCHEMA = T.StructType([
    T.StructField("connection", T.StringType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("mode", T.StringType(), False),
    T.StructField("ok", T.BooleanType(), False),
    T.StructField("message", T.StringType(), False),
])


def _reason(e: Exception) -> str:
    text = str(e)
    if "PATH_NOT_FOUND" in text or "does not exist" in text or isinstance(e, FileNotFoundError):
        return "missing"
    if "UNABLE_TO_INFER_SCHEMA" in text:
        return "no schema"
    return "unreadable"


def diagnose(catalog, mode: str = "schema") -> DataFrame:
    if mode not in ("schema", "sample", "read"):
        raise ValueError("mode must be 'schema', 'sample' or 'read'")
    if mode == "read":
        return _read_all(catalog)
    spark = catalog.spark
    status, frames = [], []
    for conn in catalog.connections:
        try:
            names = catalog.table_names(conn.name)
        except Exception as e:  # noqa: BLE001 - the connection itself fails
            status.append((conn.name, "*", mode, False, _reason(e)))
            continue
        for t in names:
            try:
                df = catalog.scan(conn.name, t)
                df.schema
            except Exception as e:  # noqa: BLE001 - reported as a row
                status.append((conn.name, t, mode, False, _reason(e)))
                continue
            status.append((conn.name, t, mode, True, "ok"))
            if mode != "schema":
                frames.append((conn.name, t, df.limit(1)))
    out = spark.createDataFrame(status, DIAGNOSE_SCHEMA)
    if mode == "schema":
        return out.withColumn("n_rows", F.lit(None).cast("bigint"))
    counted = count_rows(out, frames)
    return counted.select("connection", "table", "mode", "ok", "message",
                          F.when(F.col("ok"), F.col("n_rows")).alias("n_rows"))


def _tables(catalog):
    """(connection, table or ``*``, error) of everything the catalog names."""
    for conn in catalog.connections:
        try:
            for t in catalog.table_names(conn.name):
                yield conn, t, None
        except Exception as e:  # noqa: BLE001 - the connection itself fails
            yield conn, "*", e


def diagnose_files(catalog) -> DataFrame:
    """``connection, table, file, bytes, ok, message, n_rows, checksum`` of every file of every file
    connection; a table that cannot be listed gives one row without a file."""
    spark = catalog.spark
    failed, frames = [], []
    for conn, t, error in _tables(catalog):
        if conn.is_file and error is None:
            try:
                frames.append(probe_files(spark, conn, t).select(F.lit(conn.name).alias("connection"), F.lit(t).alias("table"), "*"))
            except Exception as e:  # noqa: BLE001 - reported as a row
                error = e
        if error is not None:
            failed.append((conn.name, t, None, None, False, _reason(error), None, None))
    out = spark.createDataFrame(failed, "connection string, table string, " + PROBE)
    for f in frames:
        out = out.unionByName(f)
    return out


def _read_all(catalog) -> DataFrame:
    files = diagnose_files(catalog)
    broken = F.count(F.when(~F.col("ok") & F.col("file").isNotNull(), 1))
    listed = F.count("file")
    out = files.groupBy("connection", "table").agg(
        F.lit("read").alias("mode"), F.min("ok").alias("ok"),
        F.when(broken > 0, F.format_string("%d of %d files unreadable", broken, listed)).otherwise(F.max("message")).alias("message"),
        F.when(listed > 0, F.sum("n_rows")).alias("n_rows"))
    rows = []
    for conn, t, error in _tables(catalog):
        if not conn.is_file:  # one small query a database table: one that fails is a row
            n = None
            try:
                n = catalog.scan(conn.name, t).count() if error is None else None
            except Exception as e:  # noqa: BLE001 - reported as a row
                error = e
            rows.append((conn.name, t, "read", error is None, "ok" if error is None else _reason(error), n))
    return out.unionByName(catalog.spark.createDataFrame(rows, "connection string, table string, mode string, ok boolean, "
                                                               "message string, n_rows long"))
