"""JDBC sources: SQL Server (S4), Snowflake (S5), Postgres (S9), generic JDBC
(Derby in the tests); table and column listing (C3-C5); append sink (K5).

Reads are split into tasks of equally many rows (``splits``), by the column that the connection
names or else by a key of the table, or into equal ranges between bounds that the connection
states. They always keep the table a lazy
DataFrame so Spark pushes filters and the projection into the database query.
Listings are one metadata query per connection, not one per table.
"""

from __future__ import annotations

import uuid
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.session import env_secret
from vantage.sources import jdbc_append, splits

DRIVERS = {
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
    "postgres": "org.postgresql.Driver",
}

# Read options passed through as they are when set on a connection.
_PASS_THROUGH = ("fetchsize", "queryTimeout", "sessionInitStatement", "customSchema",
                 "preferTimestampNTZ", "pushDownPredicate", "pushDownAggregate",
                 "pushDownLimit", "pushDownOffset", "pushDownTableSample")


def url_of(conn) -> str:
    o = conn.options
    if "url" in o:
        return o["url"]
    if conn.source == "sqlserver":
        return (f"jdbc:sqlserver://{o['server']};databaseName={o['database']};"
                f"encrypt={str(o.get('encrypt', True)).lower()};"
                f"trustServerCertificate={str(o.get('trust_server_certificate', False)).lower()}")
    if conn.source == "snowflake":
        parts = [f"db={o['database']}", f"schema={o['schema']}"]
        for key in ("warehouse", "role"):
            if key in o:
                parts.append(f"{key}={o[key]}")
        return f"jdbc:snowflake://{o['account']}.snowflakecomputing.com/?{'&'.join(parts)}"
    if conn.source == "postgres":
        return f"jdbc:postgresql://{o['host']}:{o.get('port', 5432)}/{o['database']}"
    raise ValueError(f"connection {conn.name!r} needs a 'url'")


def base_options(conn) -> dict[str, str]:
    o = conn.options
    opts = {"url": url_of(conn)}
    driver = o.get("driver") or DRIVERS.get(conn.source)
    if driver:
        opts["driver"] = driver
    if "user" in o:
        opts["user"] = env_secret(o["user"])
    if "password" in o:
        opts["password"] = env_secret(o["password"])
    for k in _PASS_THROUGH:
        if k in o:
            opts[k] = str(o[k])
    opts.setdefault("fetchsize", "10000")
    return opts


def qualified(conn, table: str) -> str:
    schema = conn.options.get("schema")
    if conn.source == "snowflake" and "database" in conn.options:
        return f"{conn.options['database']}.{schema}.{table}"
    return f"{schema}.{table}" if schema else table


def snowflake_connector_options(conn, table: str) -> dict[str, str]:
    """Options of the Snowflake Spark connector (``format("snowflake")``), used
    when the connection says ``connector: spark`` and the connector jar is on the
    classpath; it unloads through stage files in parallel instead of one JDBC
    result set."""
    o = conn.options
    opts = {"sfURL": f"{o['account']}.snowflakecomputing.com", "sfDatabase": o["database"],
            "sfSchema": o["schema"], "dbtable": table}
    for key, name in (("user", "sfUser"), ("password", "sfPassword"),
                      ("warehouse", "sfWarehouse"), ("role", "sfRole")):
        if key in o:
            opts[name] = env_secret(o[key])
    return opts


def read_table(spark: SparkSession, conn, table: str, partition_column: str | None = None,
               lower_bound=None, upper_bound=None, num_partitions: int | None = None,
               **options) -> DataFrame:
    """``dbtable`` scan in several tasks (connection option ``partitions: {table: {column, lower, upper,
    num}}`` or args): equal ranges where both bounds are stated, else equal numbers of rows."""
    if conn.source == "snowflake" and conn.options.get("connector") == "spark":
        return (spark.read.format("snowflake")
                .options(**snowflake_connector_options(conn, table)).load())
    opts = table_options(conn, table) | {k: str(v) for k, v in options.items()}
    part = dict(conn.options.get("partitions", {}).get(table, {}))
    column = partition_column or part.get("column")
    lower = part.get("lower") if lower_bound is None else lower_bound
    upper = part.get("upper") if upper_bound is None else upper_bound
    tasks = num_partitions or part.get("num")
    if column:
        column = _exact_column(spark, opts, column)
    if column is None or lower is None or upper is None:
        return splits.read_split(spark, conn, table, opts, column, tasks)
    opts.update(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(tasks or 8))
    return spark.read.format("jdbc").options(**opts).load()


def table_options(conn, table: str) -> dict[str, str]:
    return base_options(conn) | {"dbtable": qualified(conn, table)}


def _exact_column(spark: SparkSession, opts: Mapping[str, str], column: str) -> str:
    """The column's name as the database spells it (schema only, no rows read)."""
    names = spark.read.format("jdbc").options(**opts).load().columns
    for n in names:
        if n == column:
            return n
    for n in names:
        if n.lower() == column.lower():
            return n
    raise KeyError(f"no column {column!r} in {opts['dbtable']}; columns are {names}")


# -- listing (C3-C5) ----------------------------------------------------------

def _tables_sql(conn) -> str:
    schema = conn.options.get("schema", "")
    if conn.source == "jdbc" and url_of(conn).startswith("jdbc:derby"):
        return ("SELECT t.TABLENAME AS TABLE_NAME FROM SYS.SYSTABLES t "
                "JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID "
                f"WHERE t.TABLETYPE = 'T' AND s.SCHEMANAME = '{schema.upper() or 'APP'}'")
    prefix = f"{conn.options['database']}." if conn.source == "snowflake" else ""
    return (f"SELECT TABLE_NAME FROM {prefix}INFORMATION_SCHEMA.TABLES "
            f"WHERE TABLE_TYPE = 'BASE TABLE' AND TABLE_SCHEMA = '{schema}'")


def _columns_sql(conn) -> str | None:
    schema = conn.options.get("schema", "")
    if conn.source == "jdbc" and url_of(conn).startswith("jdbc:derby"):
        return None
    prefix = f"{conn.options['database']}." if conn.source == "snowflake" else ""
    return (f"SELECT c.TABLE_NAME, c.ORDINAL_POSITION, c.COLUMN_NAME, c.DATA_TYPE, c.IS_NULLABLE "
            f"FROM {prefix}INFORMATION_SCHEMA.COLUMNS c JOIN {prefix}INFORMATION_SCHEMA.TABLES t "
            f"ON c.TABLE_SCHEMA = t.TABLE_SCHEMA AND c.TABLE_NAME = t.TABLE_NAME "
            f"WHERE t.TABLE_TYPE = 'BASE TABLE' AND c.TABLE_SCHEMA = '{schema}'")


def _query(spark: SparkSession, conn, sql: str) -> DataFrame:
    opts = base_options(conn)
    opts["query"] = sql
    return spark.read.format("jdbc").options(**opts).load()


def list_tables(spark: SparkSession, conn) -> DataFrame:
    """(connection, source, table, location) from one metadata query."""
    df = _query(spark, conn, _tables_sql(conn))
    name_col = [c for c in df.columns if c.upper() == "TABLE_NAME"][0]
    out = df.select(F.lit(conn.name).alias("connection"), F.lit(conn.source).alias("source"),
                    F.col(name_col).cast("string").alias("table"),
                    F.lit(None).cast("string").alias("location"))
    if "table" in conn.options:
        out = out.filter(F.col("table") == conn.options["table"])
    return out


def table_names(spark: SparkSession, conn) -> list[str]:
    # The list of table names is metadata (one row per table), not data.
    return [r["table"] for r in list_tables(spark, conn).select("table").collect()]


def list_columns(spark: SparkSession, conn) -> DataFrame:
    """Every column of the connection's tables by ONE query (C4), not one per table."""
    sql = _columns_sql(conn)
    if sql is None:  # Derby has no information_schema: resolve schemas, no data read
        from vantage.catalog import COLUMNS_SCHEMA, _schema_rows
        rows = []
        for t in table_names(spark, conn):
            schema = spark.read.format("jdbc").options(**table_options(conn, t)).load().schema
            rows.extend(_schema_rows(conn.name, t, schema))
        return spark.createDataFrame(rows, COLUMNS_SCHEMA)
    df = _query(spark, conn, sql)
    cols = {c.upper(): c for c in df.columns}
    out = df.select(
        F.lit(conn.name).alias("connection"),
        F.col(cols["TABLE_NAME"]).cast("string").alias("table"),
        F.col(cols["ORDINAL_POSITION"]).cast("int").alias("position"),
        F.col(cols["COLUMN_NAME"]).cast("string").alias("column_name"),
        F.lower(F.col(cols["DATA_TYPE"]).cast("string")).alias("data_type"),
        (F.upper(F.col(cols["IS_NULLABLE"]).cast("string")) == "YES").alias("nullable"))
    if "table" in conn.options:
        out = out.filter(F.col("table") == conn.options["table"])
    return out


# -- sink (K5) -----------------------------------------------------------------

def append(df: DataFrame, conn, table: str, num_partitions: int | None = None,
           batchsize: int = 10000, column_types: str | None = None, once: bool = True, job: str | None = None) -> bool:
    """Distributed append: each task inserts its partition in batches. ``num_partitions`` caps
    concurrent connections to the database. ``once`` goes through a staging table and a ledger
    (``jdbc_append``): no task and no rerun of the same ``job`` appends twice; false if the ledger had the
    job. Without it, rows go straight into the table, and a task lost after its commit appends again."""
    opts = base_options(conn) | {"batchsize": str(batchsize)}
    if num_partitions:
        opts["numPartitions"] = str(num_partitions)
    if once:
        return jdbc_append.append_once(df, opts, qualified(conn, table), job or uuid.uuid4().hex,
                                       qualified(conn, jdbc_append.LEDGER), column_types)
    opts["dbtable"] = qualified(conn, table)
    if column_types:
        opts["createTableColumnTypes"] = column_types
    df.write.format("jdbc").options(**opts).mode("append").save()
    return True
