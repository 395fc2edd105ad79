"""Appending to a database table exactly once (K5).

A plain distributed append can append twice: a task whose executor is lost after its insert was committed runs
again, and a driver that dies after the write cannot know that it happened. Here

1. the rows are written to the shared folder, so that every attempt of a task reads the same rows;
2. tasks insert into a staging table of this call, each row with its task's partition and attempt;
3. one transaction in the database takes one attempt of each partition over into the target and
   enters the job in the ledger table ``vantage_appends``, whose key is the job's name.

An attempt that is inserted once more, or in part, is passed over; a job that the ledger has is
not appended again, whoever runs it; a call that dies before step 3 has changed nothing in the target. The driver
sends a handful of statements, rows go from tasks to the database and from table to table.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.session import shared_path
from vantage.sources.splits import literal, quote

LEDGER = "vantage_appends"
PART, ATTEMPT = "__part", "__attempt"


@contextmanager
def connection(spark: SparkSession, options: dict):
    """A connection of the driver's JVM in a transaction: committed at the end, else rolled back."""
    spark.read.format("jdbc").options(**{k: v for k, v in options.items() if k != "dbtable"}, query=_PING(options)).load()  # registers the driver
    props = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            props.setProperty(k, options[k])
    con = spark._jvm.java.sql.DriverManager.getConnection(options["url"], props)
    try:
        con.setAutoCommit(False)
        yield con
        con.commit()
    except BaseException:
        con.rollback()
        raise
    finally:
        con.close()


def _PING(options: dict) -> str:
    return "SELECT 1 AS one FROM SYSIBM.SYSDUMMY1" if options["url"].startswith("jdbc:derby") else "SELECT 1 AS one"


def execute(con, sql: str) -> int:
    s = con.createStatement()
    try:
        return s.executeUpdate(sql)
    finally:
        s.close()


def number(con, sql: str) -> int:
    s = con.createStatement()
    try:
        r = s.executeQuery(sql)
        r.next()
        return r.getLong(1)
    finally:
        s.close()


def _ensure_ledger(spark: SparkSession, options: dict, ledger: str) -> None:
    try:
        with connection(spark, options) as con:
            number(con, f"SELECT COUNT(*) FROM {ledger}")
    except Exception:  # noqa: BLE001 - no such table yet; another job may make it meanwhile
        try:
            with connection(spark, options) as con:
                execute(con, f"CREATE TABLE {ledger} (job VARCHAR(200) NOT NULL PRIMARY KEY, target VARCHAR(200), n_rows BIGINT)")
        except Exception:  # noqa: BLE001
            with connection(spark, options) as con:
                number(con, f"SELECT COUNT(*) FROM {ledger}")  # raises if it could not be made


def done(spark: SparkSession, options: dict, ledger: str, job: str) -> bool:
    with connection(spark, options) as con:
        return number(con, f"SELECT COUNT(*) FROM {ledger} WHERE job = {literal(job)}") > 0


def stage(rows: DataFrame, options: dict, staging: str) -> None:
    """Insert ``rows`` into the staging table, each with its task's partition and attempt."""
    schema = T.StructType([*rows.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(ATTEMPT, T.LongType())])

    def marked(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array([attempt] * b.num_rows, pa.int64())],
                names=[*b.schema.names, PART, ATTEMPT])
    rows.mapInArrow(marked, schema).write.format("jdbc").options(**options, dbtable=staging).mode("append").save()


def merge(spark: SparkSession, options: dict, target: str, staging: str, ledger: str, job: str, columns: list[str], expected: int) -> bool:
    """Take one attempt of each partition over and enter the job, in one transaction; false if the ledger had it."""
    part, attempt, cols = quote(PART), quote(ATTEMPT), ", ".join(map(quote, columns))
    # of each partition the fullest attempt (an attempt is whole unless the database has no transactions), of equal ones the first
    sizes = f"SELECT {part} AS p, {attempt} AS a, COUNT(*) AS n FROM {staging} GROUP BY {part}, {attempt}"
    full = f"SELECT x.p AS p, MIN(x.a) AS a FROM ({sizes}) x JOIN (SELECT p, MAX(n) AS n FROM ({sizes}) y GROUP BY p) z ON x.p = z.p AND x.n = z.n GROUP BY x.p"
    chosen = f"FROM {staging} s JOIN ({full}) c ON s.{part} = c.p AND s.{attempt} = c.a"
    with connection(spark, options) as con:
        n = number(con, f"SELECT COUNT(*) {chosen}")
        if n != expected:
            raise RuntimeError(f"{staging} holds {n} of {expected} rows; {target} is unchanged")
        try:
            execute(con, f"INSERT INTO {ledger} (job, target, n_rows) VALUES ({literal(job)}, {literal(target)}, {expected})")
        except Exception:  # noqa: BLE001 - the key is taken, or something is wrong
            con.rollback()
            if number(con, f"SELECT COUNT(*) FROM {ledger} WHERE job = {literal(job)}"):
                return False
            raise
        execute(con, f"INSERT INTO {target} ({cols}) SELECT {', '.join('s.' + quote(c) for c in columns)} {chosen}")
    return True


def append_once(df: DataFrame, options: dict, target: str, job: str, ledger: str, column_types: str | None = None) -> bool:
    """Append ``df`` to ``target`` as the job ``job``; false if that job is in the ledger already."""
    spark = df.sparkSession
    if any(c in df.columns for c in (PART, ATTEMPT)):
        raise ValueError(f"columns {PART} and {ATTEMPT} are reserved")
    _ensure_ledger(spark, options, ledger)
    if done(spark, options, ledger, job):
        return False
    path = shared_path(spark, "appends")
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    typed = options | ({"createTableColumnTypes": column_types} if column_types else {})
    # the target, where there is none yet, and the staging table beside it, with Spark's types
    rows.limit(0).write.format("jdbc").options(**typed, dbtable=target).mode("append").save()
    staging = f"{target}_{uuid.uuid4().hex[:12]}"
    marks = rows.limit(0).withColumn(PART, F.lit(0)).withColumn(ATTEMPT, F.lit(0).cast("long"))
    marks.write.format("jdbc").options(**typed, dbtable=staging).mode("append").save()
    try:
        stage(rows, options, staging)
        return merge(spark, options, target, staging, ledger, job, df.columns, rows.count())
    finally:
        with connection(spark, options) as con:
            execute(con, f"DROP TABLE {staging}")
