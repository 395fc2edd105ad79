"""Connections and the catalog.

A connection is a named spec (``source`` plus options). The catalog lists
tables and columns as DataFrames built from schemas only: no table data is
read, collected or copied to list it.
"""

from __future__ import annotations

import itertools
import os
import re
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_SOURCES = ("csv", "parquet", "json", "api")
JDBC_SOURCES = ("sqlserver", "snowflake", "postgres", "jdbc")
SOURCES = FILE_SOURCES + JDBC_SOURCES

# File extensions stripped from a file name to give the table name.
_EXTENSIONS = (".csv", ".parquet", ".json", ".jsonl")

TABLES_SCHEMA = T.StructType([
    T.StructField("connection", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("location", T.StringType(), True),
])

COLUMNS_SCHEMA = T.StructType([
    T.StructField("connection", T.StringType(), False),
    T.StructField("table", T.StringType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("nullable", T.BooleanType(), False),
])


class UnknownSource(ValueError):
    pass


class UnknownTable(KeyError):
    pass


def table_name_of(path: str) -> str:
    """``inputs/customer.csv`` -> ``customer``; a folder keeps its name."""
    base = os.path.basename(path.rstrip("/"))
    for ext in _EXTENSIONS:
        if base.lower().endswith(ext):
            return base[: -len(ext)]
    return base


_SERIAL = itertools.count(1)


@dataclass(frozen=True)
class Connection:
    """A named source. ``source`` must be one of ``SOURCES`` exactly."""

    name: str
    source: str
    options: Mapping[str, Any] = field(default_factory=dict)
    serial: int = field(default=0, compare=False)  # set by Catalog.register

    def __post_init__(self):
        if self.source not in SOURCES:
            raise UnknownSource(
                f"unknown source {self.source!r} for connection {self.name!r}; "
                f"expected one of {', '.join(SOURCES)}")
        if not self.name or "__" in self.name:
            raise ValueError(f"bad connection name {self.name!r} ('__' is reserved)")
        object.__setattr__(self, "options", MappingProxyType(dict(self.options)))

    @property
    def is_file(self) -> bool:
        return self.source in FILE_SOURCES

    def files(self) -> list[str]:
        root = self.options.get("root")
        out = []
        for f in self.options.get("files", ()):
            out.append(f if (root is None or os.path.isabs(f) or "://" in f)
                       else os.path.join(root, f))
        return out

    def file_tables(self) -> dict[str, str]:
        """table name -> path, for file connections."""
        tables: dict[str, str] = {}
        for path in self.files():
            name = table_name_of(path)
            if name in tables:
                raise ValueError(f"two files give table {name!r} in {self.name!r}")
            tables[name] = path
        return tables


class Catalog:
    """Registry of connections plus their materialised tables."""

    def __init__(self, spark: SparkSession, connections: Iterable[Connection] = (), snapshots: str | None = None):
        """``snapshots``: ``fresh`` reads a table's newest version in the shared folder while its source is
        unchanged, ``any`` whatever the source is now, None never."""
        if snapshots not in (None, "fresh", "any"):
            raise ValueError("snapshots must be 'fresh', 'any' or None")
        self.spark = spark
        self.snapshots = snapshots
        self._conns: dict[str, Connection] = {}
        self._materialised: dict[tuple[str, str], str] = {}
        # Resolved scans keyed by the registration: a DataFrame keeps its file
        # listing and schema, so a table is listed and its schema read once, not per
        # query; registering a connection again, even alike, lists its files anew.
        self._frames: dict[tuple, DataFrame] = {}
        for c in connections:
            self._conns[c.name] = c

    def fork(self) -> "Catalog":
        """A copy that shares the resolved scans; changes to it stay its own."""
        other = Catalog(self.spark, snapshots=self.snapshots)
        other._conns = dict(self._conns)
        other._materialised = dict(self._materialised)
        other._frames = self._frames  # keyed by registration: safe to share
        return other

    def refresh(self, connection: str | None = None) -> None:
        """Forget resolved scans (all, or one connection's) to see new files."""
        for key in [k for k in self._frames if connection is None or k[0] == connection
                    or (k[0] == "__names__" and k[1] == connection)]:
            del self._frames[key]

    # -- C1 / C8 -----------------------------------------------------------
    @classmethod
    def from_specs(cls, spark: SparkSession, specs) -> "Catalog":
        """Specs as a mapping ``{key: {name, source, ...}}`` (YAML shape) or a list."""
        items = specs.values() if isinstance(specs, Mapping) else specs
        cat = cls(spark)
        for spec in items:
            spec = dict(spec)
            cat.register(spec.pop("name"), spec.pop("source"), **spec)
        return cat

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str) -> "Catalog":
        """Connections from a settings file of the shape ``{key: {name, source, ...}}``.
        Secrets belong in the environment (``password: env:NAME``), not the file."""
        import yaml
        with open(path) as fh:
            specs = yaml.safe_load(fh) or {}
        return cls.from_specs(spark, specs)

    def register(self, name: str, source: str, **options) -> Connection:
        """Add a connection; a same-named one is replaced (upload semantics)."""
        conn = Connection(name, source, options)
        object.__setattr__(conn, "serial", next(_SERIAL))
        self._conns[name] = conn
        for key in [k for k in self._materialised if k[0] == name]:
            del self._materialised[key]
        return conn

    def connection(self, name: str) -> Connection:
        try:
            return self._conns[name]
        except KeyError:
            raise UnknownTable(f"no connection {name!r}") from None

    @property
    def connections(self) -> list[Connection]:
        return list(self._conns.values())

    # -- listing -----------------------------------------------------------
    def table_names(self, name: str) -> list[str]:
        conn = self.connection(name)
        if "table" in conn.options:  # C6: restrict a connection to one table
            return [conn.options["table"]]
        if conn.is_file:
            return list(conn.file_tables())
        from vantage.sources import jdbc
        key = ("__names__", name, conn.serial, repr(sorted(conn.options.items())))
        if key not in self._frames:  # one listing query per connection spec
            self._frames[key] = jdbc.table_names(self.spark, conn)
        return list(self._frames[key])

    def tables(self) -> DataFrame:
        """One row per (connection, table); JDBC tables are listed by one query each
        connection, file tables from the spec."""
        from vantage.sources import jdbc
        rows, frames = [], []
        for conn in self._conns.values():
            if conn.is_file:
                only = conn.options.get("table")
                for t, path in conn.file_tables().items():
                    if only is None or t == only:
                        rows.append((conn.name, conn.source, t, path))
            else:
                frames.append(jdbc.list_tables(self.spark, conn))
        out = self.spark.createDataFrame(rows, TABLES_SCHEMA)
        for f in frames:
            out = out.unionByName(f)
        return out

    def columns(self) -> DataFrame:
        """(connection, table, position, column_name, data_type, nullable), from
        schemas only. JDBC connections use one metadata query each (C4)."""
        from vantage.sources import jdbc
        rows, frames = [], []
        for conn in self._conns.values():
            if conn.is_file:
                for t in self.table_names(conn.name):
                    schema = self.scan(conn.name, t).schema
                    rows.extend(_schema_rows(conn.name, t, schema))
            else:
                frames.append(jdbc.list_columns(self.spark, conn))
        out = self.spark.createDataFrame(rows, COLUMNS_SCHEMA)
        for f in frames:
            out = out.unionByName(f)
        return out

    # -- scans -------------------------------------------------------------
    def scan(self, connection: str, table: str, prefer_materialised: bool = True,
             **read_options) -> DataFrame:
        """The table as a lazy DataFrame (S1-S9); a materialised copy first."""
        key = (connection, table)
        if prefer_materialised and key in self._materialised and not read_options:
            from vantage.operators.sinks import read_materialised
            return read_materialised(self.spark, self._materialised[key])
        if prefer_materialised and self.snapshots and not read_options:
            from vantage.operators import snapshots
            newest = snapshots.latest(self.spark, snapshots.folder_of(self.spark, connection, table))
            if newest and (self.snapshots == "any" or not snapshots.is_stale(self, connection, table)):
                return newest.read()
        from vantage import sources
        conn = self.connection(connection)
        if conn.is_file and table not in conn.file_tables():
            raise UnknownTable(f"no table {table!r} in connection {connection!r}")
        if "table" in conn.options and table != conn.options["table"]:
            raise UnknownTable(f"connection {connection!r} is restricted to table "
                               f"{conn.options['table']!r}")
        try:
            memo = (connection, conn.serial, repr(sorted(conn.options.items())), table,
                    tuple(sorted(read_options.items())))
            hash(memo)
        except TypeError:  # unhashable options: resolve every time
            return sources.scan(self.spark, conn, table, **read_options)
        if memo not in self._frames:
            self._frames[memo] = sources.scan(self.spark, conn, table, **read_options)
        return self._frames[memo]

    def view(self, connection: str, table: str):
        """The table as a ``View`` (filters, search, columns, sort, preview,
        structure), the viewer's screen for one table."""
        from vantage.operators.view import View
        return View(self.scan(connection, table))

    def note_materialised(self, connection: str, table: str, path: str) -> None:
        self._materialised[(connection, table)] = path

    def materialised_path(self, connection: str, table: str) -> str | None:
        return self._materialised.get((connection, table))


def _schema_rows(connection: str, table: str, schema: T.StructType):
    for i, f in enumerate(schema.fields, start=1):
        yield (connection, table, i, f.name, f.dataType.simpleString(), bool(f.nullable))


def count_rows(markers: DataFrame, frames) -> DataFrame:
    """Row counts as ONE aggregate over a union, with no join.

    ``markers`` has one row per table (``connection``, ``table`` and any
    metadata columns); ``frames`` is ``[(connection, table, df), ...]``. Every
    scan contributes a weight 1 per row and reads no columns (Parquet gives row
    counts from its footers); each marker contributes 0, so an empty table
    still gets ``n_rows = 0``. Each task pre-aggregates to one row per table
    before the single small shuffle, so a table that holds most rows is not a
    hot reducer. Metadata columns are carried through with ``max``.
    """
    meta = [c for c in markers.columns if c not in ("connection", "table")]
    typed = dict(markers.dtypes)
    union = markers.select("connection", "table", *meta, F.lit(0).alias("__w"))
    for c, t, df in frames:
        union = union.unionByName(df.select(
            F.lit(c).alias("connection"), F.lit(t).alias("table"),
            *[F.lit(None).cast(typed[m]).alias(m) for m in meta], F.lit(1).alias("__w")))
    return union.groupBy("connection", "table").agg(
        *[F.max(m).alias(m) for m in meta], F.sum("__w").cast("bigint").alias("n_rows"))


def footer_counts(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """``location, n_rows`` of Parquet tables from their footers: one scan over all of their files that reads no
    column, so a catalog of any number of tables is one job. Paths must not lie within each other."""
    roots = {re.sub("^([a-z0-9+.-]+:)/+", r"\1/", qualified_path(spark, p)): p for p in paths}
    rows = spark.read.schema(T.StructType([])).parquet(*roots.values())
    files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    # a file's table is the path it is or lies under: looked up by its beginnings of the lengths that tables have
    depths = sorted({p.count("/") + 1 for p in roots})
    file = F.regexp_replace("file", "^([a-z0-9+.-]+:)/+(?!/)", "$1/")
    starts = F.array(*(F.substring_index(file, "/", d) for d in depths))
    known = spark.createDataFrame(list(roots.items()), "key string, location string")
    found = files.select("n", F.explode(F.array_distinct(starts)).alias("key")).join(known, "key")
    return (known.select("location", F.lit(0).cast("long").alias("n")).unionByName(found.select("location", "n"))
            .groupBy("location").agg(F.sum("n").alias("n_rows")))


def qualified_path(spark: SparkSession, path: str) -> str:
    """The path as ``_metadata.file_path`` writes it: qualified, and quoted as a URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString().rstrip("/")


def with_row_counts(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """Catalog tables plus a row count each (0 for an empty table): Parquet tables together from their
    footers, others by a column-less scan each."""
    plain, frames = {}, []
    for conn in catalog.connections:
        for t in catalog.table_names(conn.name):
            path = conn.file_tables().get(t) if conn.source == "parquet" and not conn.options.get("read_options") else None
            if path and not set(path) & set("*?[{") and not any(path != p and (path.startswith(p.rstrip("/") + "/") or p.startswith(path.rstrip("/") + "/")) for p in plain):
                plain.setdefault(path, []).append((conn.name, t))
            else:
                frames.append((conn.name, t, catalog.scan(conn.name, t)))
    tables = catalog.tables()
    if not plain:
        return count_rows(tables, frames)
    slow = {(c, t) for c, t, _ in frames}
    is_slow = F.struct("connection", "table").isin([F.struct(F.lit(c), F.lit(t)) for c, t in slow]) if slow else F.lit(False)
    counts = footer_counts(spark, plain)
    out = tables.where(~is_slow).join(counts, "location").select(*tables.columns, "n_rows")
    return out.unionByName(count_rows(tables.where(is_slow), frames)) if slow else out
