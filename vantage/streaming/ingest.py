"""``watch`` a folder table as a stream; ``ingest`` new files into Parquet, ``ingest_replacing``
where an upload takes the place of an earlier one of its name."""

from __future__ import annotations

import hashlib
import uuid
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vantage.operators.predicates import FilterSpec, apply_filters
from vantage.session import shared_path


def watch(catalog, connection: str, table: str, filters: Sequence[FilterSpec] = (),
          schema=None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over the folder behind ``(connection, table)``.

    The schema is the table's batch schema unless given (file streams need a
    fixed schema). Filters are the same specs as for a batch view.
    """
    spark = catalog.spark
    conn = catalog.connection(connection)
    if conn.source not in ("csv", "parquet", "json", "api"):
        raise ValueError(f"a {conn.source} connection cannot be watched as a stream")
    path = conn.file_tables()[table]
    if schema is None:
        schema = catalog.scan(connection, table, prefer_materialised=False).schema
    # uploads may land in sub-folders (one per upload batch)
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if conn.source == "csv":
        df = reader.option("header", True).option("escape", '"').csv(path)
    elif conn.source == "parquet":
        df = reader.parquet(path)
    else:
        df = reader.option("multiLine", conn.source == "api").json(path)
        if conn.source == "api":  # payloads are flattened one level, as in batch reads
            from vantage.operators.shaping import flatten
            df = flatten(df)
    return apply_filters(df, filters)


def ingest(stream: DataFrame, target: str, checkpoint: str | None = None,
           name: str = "ingest", wait: bool = True) -> StreamingQuery:
    """Append the rows of files not yet seen to the Parquet table ``target``.

    ``availableNow`` processes everything that has arrived, in bounded
    micro-batches, then stops; the checkpoint (in the shared folder by default)
    makes reruns pick up only new files and survive lost executors.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or shared_path(
        spark, "streams", name, hashlib.sha1(target.encode()).hexdigest()[:12], unique=False)
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(target))
    if wait:
        q.awaitTermination()
    return q


def ingest_replacing(stream: DataFrame, target: str, checkpoint: str | None = None, name: str = "uploads",
                     wait: bool = True) -> StreamingQuery:
    """Keep ``target`` a versioned copy (``operators.snapshots``) of the newest upload of every file name: the rows
    of a file come in with the micro-batch that sees it, and rows of an older upload of its name leave in
    the same version. Read it with ``snapshots.latest(spark, target).read()``.

    ``stream`` is what ``watch`` gives. A name's uploads are ordered by modification time, then path. Every
    micro-batch commits one version named by its number, so a batch that Spark runs again changes
    nothing, and a reader sees each batch whole or not at all. An upload without rows is not seen.
    """
    from vantage.operators import snapshots
    spark = stream.sparkSession
    checkpoint = checkpoint or shared_path(
        spark, "streams", name, hashlib.sha1(target.encode()).hexdigest()[:12], unique=False)
    schema = stream.schema.json()
    tagged = stream.select("*", *(F.col(f"_metadata.{m}").alias(a) for m, a in (
        ("file_path", "__path"), ("file_name", "__file"), ("file_size", "__bytes"), ("file_modification_time", "__modified"))))

    def commit(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        found = snapshots.versions(session, target)
        if any(int(v.split("-")[0]) == number + 1 for v in found):
            return  # this batch was committed before
        ident = uuid.uuid4().hex[:12]
        fingerprint = F.substring(F.sha2(F.concat_ws("|", "__path", "__bytes", F.unix_micros("__modified")), 256), 1, 32)
        batch.withColumn("__source", fingerprint).drop("__path", "__file", "__bytes", "__modified").write.partitionBy("__source").parquet(
            f"{target}/data/{ident}")
        files = batch.groupBy("__file", "__path", "__bytes", "__modified", fingerprint.alias("source")).agg(F.count("*").alias("n_rows"))
        fresh = files.select(F.col("__path").alias("file"), F.col("__bytes").alias("bytes"), F.col("__modified").alias("modified"),
                             "source", "n_rows", F.concat(F.lit(f"data/{ident}/__source="), "source").alias("folder"),
                             F.lit(schema).alias("schema"))
        old = snapshots.Snapshot(session, target, found[-1]).manifest() if found else session.createDataFrame([], snapshots.MANIFEST)
        both = old.unionByName(fresh).withColumn("name", F.element_at(F.split("file", "/"), -1))
        newest = F.max_by(F.struct(*(c for c in both.columns if c != "name")), F.struct("modified", "file"))
        (both.groupBy("name").agg(newest.alias("r")).select("r.*")
         .write.parquet(f"{target}/versions/{number + 1:010d}-{ident}"))
    q = (tagged.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    if wait:
        q.awaitTermination()
    return q
