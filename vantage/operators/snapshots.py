"""Versioned copies of source tables (K1, S8) that outlive the session.

A snapshot lives in the shared folder under its connection and table:

    data/<refresh>/__source=<fingerprint>/part-*.parquet    rows of one source file
    versions/<number>-<refresh>/part-*.parquet, _SUCCESS    one row per source file

A version is its manifest: source file, size, time, fingerprint (of the three), rows, and the folder
of its rows. ``refresh`` lists the source, writes the rows of files whose fingerprint no
earlier manifest has (all in one Spark job, dealt by source file), takes the others' folders over as they are, and
writes the manifest last; Spark's ``_SUCCESS`` marker makes it visible. Folders are never rewritten, so a
reader pinned to a version sees that version whole, however many refreshes happen meanwhile, and a
refresh that dies leaves no trace in any version. Two refreshes at once give two whole
versions; the greater name is the newest.

A source is compared by its listing alone. A table of a database has no listing: a caller gives a ``token``
(a change number, a load date) that stands for its state, and it is copied whole when that differs.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.operators.fileprobe import listing
from vantage.session import shared_path

MANIFEST = "file string, bytes long, modified timestamp, source string, n_rows long, folder string, schema string"
_SOURCE = "__source"


def folder_of(spark: SparkSession, connection: str, table: str) -> str:
    return shared_path(spark, "snapshots", connection, table, unique=False)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, by its own file system (metadata only)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Committed versions, oldest first."""
    return [v for v in _names(spark, f"{folder}/versions") if "_SUCCESS" in _names(spark, f"{folder}/versions/{v}")]


@dataclass(frozen=True)
class Snapshot:
    """One committed version of a table's copy."""

    spark: SparkSession
    folder: str
    version: str

    @property
    def number(self) -> int:
        return int(self.version.split("-")[0])

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/versions/{self.version}")

    def read(self) -> DataFrame:
        """The version's rows, from its own folders."""
        schema = T.StructType.fromJson(_json(self.manifest().select("schema").first().schema))
        # folder names are metadata, one per source file, as in any file listing
        folders = [f"{self.folder}/{r.folder}" for r in self.manifest().where("n_rows > 0").select("folder").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*sorted(folders))

    def changes(self, now: DataFrame) -> DataFrame:
        """``file, change`` (added, changed, removed) of a listing against this version."""
        old = self.manifest().select("file", F.col("source").alias("old"))
        new = now.select("file", F.col("source").alias("new"))
        change = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
                  .when(F.col("old") != F.col("new"), "changed"))
        return old.join(new, "file", "full").select("file", change.alias("change")).where("change IS NOT NULL")


def _json(text: str):
    import json
    return json.loads(text)


def latest(spark: SparkSession, folder: str) -> Snapshot | None:
    found = versions(spark, folder)
    return Snapshot(spark, folder, found[-1]) if found else None


def _fingerprint(file, size, modified):
    return F.substring(F.sha2(F.concat_ws("|", file, size, F.unix_micros(modified)), 256), 1, 32)


def state(catalog, connection: str, table: str, token: str | None = None) -> DataFrame:
    """``file, bytes, modified, source``: the source's files now, with their fingerprints."""
    conn = catalog.connection(connection)
    if conn.is_file:
        files = listing(catalog.spark, conn.file_tables()[table])
        return files.withColumn("source", _fingerprint("file", "bytes", "modified"))
    # nothing to compare by without a token: always new
    return catalog.spark.createDataFrame([(f"{conn.source}:{table}", 0, None, hashlib.sha256((token or uuid.uuid4().hex).encode()).hexdigest()[:32])],
                                         "file string, bytes long, modified timestamp, source string")


def is_stale(catalog, connection: str, table: str, token: str | None = None) -> bool:
    """Whether the source differs from the newest version (true without one)."""
    newest = latest(catalog.spark, folder_of(catalog.spark, connection, table))
    return newest is None or bool(newest.changes(state(catalog, connection, table, token)).limit(1).count())


def refresh(catalog, connection: str, table: str, token: str | None = None) -> Snapshot:
    """The newest version, made to agree with the source: only new and changed files are
    copied; without any, and with none removed, no version is added."""
    spark, folder = catalog.spark, folder_of(catalog.spark, connection, table)
    conn = catalog.connection(connection)
    catalog.refresh(connection)
    rows = catalog.scan(connection, table, prefer_materialised=False)
    now = state(catalog, connection, table, token)
    newest, schema = latest(spark, folder), rows.schema.json()
    known = newest.manifest() if newest else spark.createDataFrame([], MANIFEST)
    known = known.where(F.col("schema") == schema)  # rows of another shape are copied again
    if newest and not newest.changes(now).limit(1).count() and known.limit(1).count():
        return newest
    now = now.cache()
    ident = uuid.uuid4().hex[:12]
    data = f"data/{ident}"
    todo = now.join(known.select("source"), "source", "left_anti")
    if conn.is_file:
        meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
        picked = rows.withColumn(_SOURCE, _fingerprint(*meta))
        if newest:  # names of the new and changed files alone: the scan opens no other file
            picked = picked.where(F.col("_metadata.file_path").isin([r.file for r in todo.select("file").collect()]))
    else:
        picked = rows.withColumn(_SOURCE, F.lit(now.first().source))
    picked.write.partitionBy(_SOURCE).parquet(f"{folder}/{data}")
    counts = _counts(spark, f"{folder}/{data}")
    if counts.join(todo, "source", "left_anti").limit(1).count():
        raise RuntimeError(f"{connection}.{table} changed while it was copied; refresh again")
    fresh = todo.join(counts, "source", "left").select(
        "file", "bytes", "modified", "source", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        F.concat(F.lit(f"{data}/{_SOURCE}="), "source").alias("folder"), F.lit(schema).alias("schema"))
    kept = now.join(known.select("source", "n_rows", "folder", "schema"), "source").select(fresh.columns)
    number = (newest.number if newest else 0) + 1
    version = f"{number:010d}-{ident}"
    fresh.unionByName(kept).write.parquet(f"{folder}/versions/{version}")  # committed by its _SUCCESS
    now.unpersist()
    return Snapshot(spark, folder, version)


def _counts(spark: SparkSession, data: str) -> DataFrame:
    """``source, n_rows`` of the written folders, from footers."""
    if not any(n.startswith(_SOURCE) for n in _names(spark, data)):
        return spark.createDataFrame([], "source string, n_rows long")
    found = spark.read.schema(f"{_SOURCE} string").parquet(data)
    return found.groupBy(F.col(_SOURCE).alias("source")).agg(F.count("*").alias("n_rows"))


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Forget all but the newest ``keep`` versions, then delete data that no version left names;
    returns the number of refreshes' folders deleted. Readers of forgotten versions fail, so
    keep as many as readers may be behind; no refresh may run meanwhile."""
    found = versions(spark, folder)
    for v in found[:-keep]:
        _delete(spark, f"{folder}/versions/{v}")
    used: set[str] = set()
    for v in found[-keep:]:
        names = Snapshot(spark, folder, v).manifest().where("n_rows > 0").select(F.element_at(F.split("folder", "/"), 2).alias("ident"))
        used |= {r.ident for r in names.distinct().collect()}  # one per refresh
    stale = [d for d in _names(spark, f"{folder}/data") if d not in used]
    for d in stale:
        _delete(spark, f"{folder}/data/{d}")
    return len(stale)
