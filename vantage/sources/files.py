"""File scans: CSV (S1), Parquet (S2), landed API payloads (S6), JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer_schema: bool = False, **options) -> DataFrame:
    """Header row, all columns strings unless a schema or inference is asked for.

    ``escape='"'`` so that a doubled quote inside a quoted cell is read as one
    quote (RFC 4180), which Spark's default backslash escape does not do.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    reader = reader.option("multiLine", options.pop("multiLine", False))
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer_schema:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multi_line: bool = False, flatten: bool = False, **options) -> DataFrame:
    """JSON lines by default; ``multi_line=True`` for one document per file, where a
    top-level array gives one row per element."""
    reader = spark.read.option("multiLine", multi_line)
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    if flatten:
        from vantage.operators.shaping import flatten as _flatten
        df = _flatten(df)
    return df


def read_payloads(spark: SparkSession, path: str, schema=None, flatten: bool = True,
                  multi_line: bool = True, **options) -> DataFrame:
    """API payloads landed as files in a folder (one JSON document per file by
    default), read in parallel and flattened one level like the other JSON
    sources. ``multi_line=False`` reads payloads landed as JSON lines."""
    return read_json(spark, path, schema=schema, multi_line=multi_line, flatten=flatten,
                     **options)
