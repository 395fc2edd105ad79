"""Files of a table: listing them, and reading each to its end without one broken file
failing the rest (C9).

``listing`` is Spark's own file index, so any file system Spark reads can be listed; no file is opened.
``probe_files`` reads every column of every file with ``ignoreCorruptFiles`` and sets what came
out against the listing:

* Parquet: rows that the footers promise, and rows that could be read. A file with fewer rows than its footer
  says is broken in the middle; a listed file that gives neither has no readable footer
  (truncated, or not Parquet), unless it is a file of no rows, which its footer says.
* CSV and JSON: records that do not parse under the table's schema, JSON files that
  have bytes but give no record, and gzip files whose stream is broken or ends early (up to
  ``GZIP_BYTES``, which a task holds; larger ones are judged by their records alone).

Files of no bytes are not listed: Spark's scans pass over them too.
Everything is partial aggregates per file and one aggregate over their union: tasks send one
row per file, and nothing passes through the driver. ``checksum`` is the exclusive-or of the
rows' hashes, the same for the same rows in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A Parquet file of no rows holds its schema alone; silent files up to this size are looked into.
EMPTY_BYTES = 1 << 20
GZIP_BYTES = 1 << 29
PROBE = "file string, bytes long, ok boolean, message string, n_rows long, checksum long"
_BAD = "_corrupt_record"


def listing(spark: SparkSession, path: str, **options) -> DataFrame:
    """``file, bytes, modified`` of every data file below ``path`` (hidden ones are left out as in a scan)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).options(**options).load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
                        F.col("_metadata.file_modification_time").alias("modified"))


def _hashable(field: T.StructField) -> Column:
    """A column as something that a hash takes in whole; maps and variants as JSON text."""
    quoted = "`" + field.name.replace("`", "``") + "`"
    kind = field.dataType.simpleString()
    if "map<" in kind or "variant" in kind:
        return F.to_json(F.struct(F.col(quoted)))
    return F.col(quoted)


def row_hash(schema: T.StructType) -> Column:
    """A hash of all columns, which makes a scan read all of them."""
    return F.xxhash64(*map(_hashable, schema.fields)) if schema.fields else F.lit(0).cast("long")


def _per_file(df: DataFrame, **sums: Column) -> DataFrame:
    """``file, <sums>`` by the file that the rows come from."""
    inner = {k: v.alias(k) for k, v in sums.items()}
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(*inner.values())


def _empty_parquet(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of the Parquet files of no rows, by the footers of the small files."""
    small = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .where(F.col("length") <= EMPTY_BYTES))  # pushed into the scan: larger files are not opened

    def footers(batches):
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq
        for b in batches:
            files = []
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    if pq.ParquetFile(io.BytesIO(content.as_py())).metadata.num_rows == 0:
                        files.append(file)
                except (pa.ArrowInvalid, OSError):
                    pass  # no Parquet file: stays silent, and is reported for that
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])
    return small.select(F.col("_metadata.file_path").alias("file"), "content").mapInArrow(footers, "file string")


def _cut_gzip(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of the gzip files that cannot be inflated to their end."""
    packed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path)
              .where(F.col("length") <= GZIP_BYTES))

    def inflate(batches):
        import zlib

        import pyarrow as pa
        for b in batches:
            cut = []
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                left = content.as_buffer().to_pybytes()
                try:
                    while left:  # members one after another, a megabyte of output at a time
                        member = zlib.decompressobj(31)
                        while not member.eof and (left or member.unconsumed_tail):
                            member.decompress(member.unconsumed_tail or left, 1 << 20)
                            left = b""
                        left = member.unused_data
                        if not member.eof:
                            raise zlib.error
                except zlib.error:
                    cut.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string())], names=["file"])
    return packed.select(F.col("_metadata.file_path").alias("file"), "content").mapInArrow(inflate, "file string")


def _reader(spark: SparkSession, conn, table: str):
    """The connection's reader with broken files passed over, its path and stated schema."""
    opts = dict(conn.options.get("read_options", {}))
    schema = opts.pop("schema", None) or (conn.options.get("schemas") or {}).get(table)
    many = opts.pop("multi_line", conn.source == "api")
    for own in ("flatten", "infer_schema"):
        opts.pop(own, None)
    reader = spark.read.options(**{k: str(v) for k, v in opts.items()}).option("ignoreCorruptFiles", True)
    if conn.source == "csv":
        reader = reader.option("header", True).option("escape", '"')
    elif conn.source in ("json", "api"):
        reader = reader.option("multiLine", many)
    return reader, conn.file_tables()[table], schema


def probe_files(spark: SparkSession, conn, table: str) -> DataFrame:
    """``PROBE``: a row for every file of a file connection's table. Listing a missing path
    raises, as a scan of it does."""
    reader, path, schema = _reader(spark, conn, table)
    parts = [listing(spark, path).select("file", "bytes")]
    kind = "parquet" if conn.source == "parquet" else "csv" if conn.source == "csv" else "json"
    try:
        plain = (reader.schema(schema) if schema else reader).format(kind).load(path)
    except Exception as e:  # noqa: BLE001 - no file has a schema to read by: all are silent
        if "INFER" not in str(e) and "CORRUPT" not in str(e).upper():
            raise
        plain = None
    if plain is not None and kind == "parquet":
        parts.append(_per_file(plain, n_rows=F.count("*"), checksum=F.bit_xor(row_hash(plain.schema))))
        parts.append(_per_file(plain, promised=F.count("*")))
    elif plain is not None:
        flagged = T.StructType([f for f in plain.schema.fields if f.name != _BAD] + [T.StructField(_BAD, T.StringType())])
        read = reader.schema(flagged).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD).format(kind).load(path)
        parts.append(_per_file(read, n_rows=F.count(F.when(F.col(_BAD).isNull(), 1)), bad=F.count(_BAD),
                               checksum=F.bit_xor(row_hash(plain.schema))))
    if kind == "parquet":
        parts.append(_empty_parquet(spark, path).withColumn("promised", F.lit(0).cast("long")))
    else:
        parts.append(_cut_gzip(spark, path).withColumn("cut", F.lit(1).cast("long")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    for c in ("n_rows", "bad", "promised", "checksum", "cut"):
        if c not in union.columns:
            union = union.withColumn(c, F.lit(None).cast("long"))
    n, bad, promised = F.coalesce("read.n_rows", F.lit(0)), F.coalesce("bad", F.lit(0)), F.col("promised")
    # rows and checksum as one value: a caller who drops the checksum still reads every column
    read = F.max(F.when(F.col("n_rows").isNotNull(), F.struct("n_rows", "checksum"))).alias("read")
    if kind == "parquet":
        fault = F.when(promised.isNull(), "no readable footer").when(
            n < promised, F.format_string("%d of %d rows readable", n, promised))
    else:
        fault = (F.when(F.col("cut") > 0, "compressed stream is broken")
                 .when(F.col("read").isNull() & (F.col("bytes") > 0) & F.lit(plain is None or kind == "json"), "no readable record")
                 .when(bad > 0, F.format_string("%d malformed records", bad)))
    return (union.groupBy("file").agg(read, *(F.max(c).alias(c) for c in ("bytes", "bad", "promised", "cut")))
            .select("file", "bytes", fault.isNull().alias("ok"), F.coalesce(fault, F.lit("ok")).alias("message"),
                    n.alias("n_rows"), F.col("read.checksum").alias("checksum")))
