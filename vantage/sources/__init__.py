"""Scans (S1-S9): every source gives a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vantage.sources import files, jdbc


def scan(spark: SparkSession, conn, table: str, **read_options) -> DataFrame:
    src = conn.source
    if conn.is_file:
        path = conn.file_tables()[table]
        opts = {**dict(conn.options.get("read_options", {})), **read_options}
        schemas = conn.options.get("schemas") or {}
        if table in schemas and "schema" not in opts:
            opts["schema"] = schemas[table]
        if src == "csv":
            return files.read_csv(spark, path, **opts)
        if src == "parquet":
            return files.read_parquet(spark, path, **opts)
        if src == "json":
            return files.read_json(spark, path, **opts)
        if src == "api":
            return files.read_payloads(spark, path, **opts)
    return jdbc.read_table(spark, conn, table, **read_options)
