"""Sinks: materialise a table (K1) and its structure (K2), export a result (K3,
K4, K6), append to a database (K5), create a table from a query (T8).

Every write is a distributed DataFrame write (one file per task, or per
``max_records_per_file`` rows); nothing passes through the driver. Writes go
to a path the caller gives, or to the cluster's shared folder
(``spark.checkpoint.dir``); without that setting only a local session gets a folder
of its own, any other one an error.
"""

from __future__ import annotations

import re
import uuid
from typing import Sequence

from pyspark.sql import DataFrame

from vantage.session import shared_path

EXPORT_FORMATS = ("parquet", "csv", "json")
BUCKET_BYTES = 256 << 20
# How an exported CSV is written, and with READ_CSV read back without change:
# blanks, line ends and quotes stay, a null cell is empty and an empty text is "".
WRITE_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
             "lineSep": "\n"}
READ_CSV = {"multiLine": True, "nullValue": "\x00", "lineSep": "\n"}


def materialise(df: DataFrame, path: str | None = None, catalog=None,
                connection: str | None = None, table: str | None = None,
                structure_path: str | None = None,
                bucket_by: tuple[int | None, Sequence[str]] | None = None) -> DataFrame:
    """K1: write the table as Parquet (types kept, nullable ints stay ints) and
    return the re-read copy, which cuts the lineage. With a catalog, later scans
    of ``(connection, table)`` read the copy (S8). K2: ``structure_path``
    also writes the table's structure rows.

    ``bucket_by=(n, [cols])`` writes a bucketed (and bucket-sorted) table
    registered in the session catalog: two tables bucketed the same way on the
    join key are joined without a shuffle of either side. ``n=None`` takes one
    bucket for each ``BUCKET_BYTES`` that Spark expects; rows are dealt to their buckets
    before the write, so a bucket is one file. The table has a name of its own per
    call, and a key with very many rows stays in one bucket: leave such tables unbucketed."""
    spark = df.sparkSession
    if path is None:
        path = shared_path(spark, "materialised", connection or "adhoc", table or "table")
    if bucket_by is not None:
        n, cols = bucket_by
        n = int(n or buckets_for(df))
        ident = "vantage_" + re.sub(r"\W", "_", f"{connection or 'adhoc'}__{table or 'table'}") + "_" + uuid.uuid4().hex[:12]
        (df.repartition(n, *cols).write.mode("overwrite").option("path", path).format("parquet")
         .bucketBy(n, *cols).sortBy(*cols).saveAsTable(ident))
        location = f"table:{ident}"
    else:
        df.write.mode("overwrite").parquet(path)
        location = path
    if structure_path is not None:
        from vantage.operators.shaping import structure
        structure(read_materialised(spark, location), profile=True).coalesce(1).write.mode("overwrite").parquet(structure_path)
    if catalog is not None and connection and table:
        catalog.note_materialised(connection, table, location)
    return read_materialised(spark, location)


def buckets_for(df: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES`` each, by the optimiser's size estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(100_000, -(-size // BUCKET_BYTES)))


def read_materialised(spark, location: str) -> DataFrame:
    if location.startswith("table:"):
        return spark.table(location[len("table:"):])
    return spark.read.parquet(location)


def export(df: DataFrame, path: str, fmt: str = "csv", max_records_per_file: int | None = None,
           mode: str = "overwrite", partition_by=None) -> str:
    """K3/K4/K6: distributed export. ``path`` may be any Hadoop URI
    (``s3a://bucket/folder/table``); CSV gets a header row and
    keeps every cell as it is (read it back with the options ``READ_CSV``)."""
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"format must be one of {EXPORT_FORMATS}")
    w = df.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.options(**WRITE_CSV).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def create_table(df: DataFrame, catalog, connection: str, table: str,
                 path: str | None = None) -> DataFrame:
    """Write a query result (e.g. a join across connections) as a new
    Parquet table and register it in ``connection`` (a parquet connection is
    created or extended), so later worksheets can read it."""
    spark = df.sparkSession
    if path is None:
        path = shared_path(spark, "tables") + "/" + table  # its last part names the table
    df.write.mode("overwrite").parquet(path)
    try:
        conn = catalog.connection(connection)
        if conn.source != "parquet":
            raise ValueError(f"connection {connection!r} is {conn.source}, not parquet")
        files = [f for f in conn.files() if not f.rstrip("/").endswith("/" + table)]
        opts = {k: v for k, v in conn.options.items() if k not in ("files", "root")}
        catalog.register(connection, "parquet", files=files + [path], **opts)
    except KeyError:
        catalog.register(connection, "parquet", files=[path])
    return spark.read.parquet(path)


def append_jdbc(df: DataFrame, catalog, connection: str, table: str, **options) -> None:
    """K5: append to a database table through JDBC (distributed batches)."""
    from vantage.sources import jdbc
    jdbc.append(df, catalog.connection(connection), table, **options)
