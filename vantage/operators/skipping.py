"""A skipping index for text search (T5, P3): per file and column, a bitmap of the character
trigrams that its values hold, kept beside the table.

A value that contains a text contains its trigrams, so a file in whose bitmaps a trigram of the text is missing
cannot hold a match and is not opened. ``candidates`` leaves out only such files, and only while
their size and time are those that were indexed: a file that is new or was replaced is always read.
A bitmap has ``BITS`` bits by column (32 kB); two trigrams may share a bit, which costs a read and never a match.

Built and asked with Spark's own functions: trigrams are generated and folded into bitmaps within the
tasks, which send one row per file, column and 64 bits of a bitmap. The names of the files to read come to the
driver, as they do in any file listing.
"""

from __future__ import annotations

from typing import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators.fileprobe import listing
from vantage.operators.shaping import ref, search

BITS, PART_BITS, GRAM = 1 << 18, 1 << 15, 3  # Spark's bitmaps have parts of 32,768 bits


def _grams(text):
    """Trigrams of a text column, all found in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * GRAM}))."))


def _bit(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def build(spark: SparkSession, path: str, index: str, columns: Sequence[str] | None = None) -> str:
    """Write the index of the Parquet table ``path`` to ``index``, over its columns that have a text."""
    df = spark.read.parquet(path)
    names = list(columns) if columns is not None else [f.name for f in df.schema.fields if f.dataType.simpleString() not in ("binary", "variant")
                                                       and not f.dataType.simpleString().startswith(("array", "map", "struct"))]
    meta = [F.col(f"_metadata.{m}").alias(a) for m, a in (("file_path", "file"), ("file_size", "bytes"), ("file_modification_time", "modified"))]
    cells = df.select(*meta, F.explode(F.array(*(F.struct(F.lit(i).alias("column"), F.lower(ref(c).cast("string")).alias("text"))
                                                 for i, c in enumerate(names)))).alias("cell"))
    bits = (cells.select("file", "bytes", "modified", "cell.column", F.explode(_grams(F.col("cell.text"))).alias("gram"))
            .select("file", "bytes", "modified", "column", _bit(F.col("gram")).alias("bit")))
    # first into words of 64 bits, which a hash aggregate holds (bitmaps would be sorted, a row for each trigram)
    words = (bits.groupBy("file", "bytes", "modified", "column", (F.expr(f"bit div {PART_BITS}") + 1).alias("part"),
                          F.expr(f"int(bit % {PART_BITS} div 64)").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(56 - bit % 64 div 8 * 8 + bit % 8))")).alias("bits")))
    digits = F.aggregate(F.array_sort(F.collect_list(F.struct("word", "bits"))), F.lit(""),
                         lambda done, w: F.concat(F.rpad(done, w.word * 16, "0"), F.lpad(F.hex(w.bits), 16, "0")))
    rows = words.groupBy("file", "bytes", "modified", "column", "part").agg(F.unhex(F.rpad(digits, PART_BITS // 4, "0")).alias("bitmap"))
    every = listing(spark, path).select("file", "bytes", "modified", F.lit(None).cast("int").alias("column"),
                                        F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("bitmap"))
    named = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    (rows.unionByName(every).withColumn("column", F.get(named, F.col("column"))).withColumn("columns", named)
     .repartition("file").write.mode("overwrite").parquet(index))
    return index


def candidates(spark: SparkSession, path: str, index: str, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``file`` of the data files of ``path`` that may hold ``text`` in one of the columns (any case)."""
    now = listing(spark, path).select("file", "bytes", "modified")
    needle = text.lower()
    grams = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
    if not grams or not needle.isascii() or "Σ" in text:
        # too short to look up; other alphabets' lower case may depend on what stands beside a letter
        return now.select("file")
    rows = spark.read.parquet(index)
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(_bit(F.col("gram")).alias("bit")).distinct()
    wanted = wanted.select((F.expr(f"bit div {PART_BITS}") + 1).alias("part"), (F.col("bit") % PART_BITS).cast("int").alias("at"))
    needed = F.broadcast(wanted.groupBy("part").agg(F.collect_list("at").alias("places")))  # the text's trigrams
    picked = rows.where("part IS NOT NULL")
    if columns is not None:
        picked = picked.where(F.col("column").isin(list(columns)))
    has = "int(conv(hex(substring(bitmap, at div 8 + 1, 1)), 16, 10)) & shiftleft(1, at % 8) > 0"
    hits = (picked.join(needed, "part").select("file", "column", F.expr(f"size(filter(places, at -> {has}))").alias("n"))
            .groupBy("file", "column").agg(F.sum("n").alias("n")))
    full = hits.where(F.col("n") == wanted.count()).select("file").distinct()
    known = rows.where("part IS NULL")
    if columns is not None:  # a column that was not indexed may hold anything
        known = known.where(F.array_size(F.array_except(F.array(*map(F.lit, columns)), "columns")) == 0)
    ruled_out = known.select("file", "bytes", "modified").join(full, "file", "left_anti")
    return now.join(ruled_out, ["file", "bytes", "modified"], "left_anti").select("file")


def search_files(spark: SparkSession, path: str, index: str, text: str, columns: Sequence[str] | None = None,
                 case_sensitive: bool = False) -> DataFrame:
    """``shaping.search`` of the table ``path``, opening only files that may hold a match."""
    schema = spark.read.parquet(path).schema
    files = [unquote(r.file) for r in candidates(spark, path, index, text, columns).collect()]  # listed as URIs
    if not files:
        return spark.createDataFrame([], schema)
    return search(spark.read.schema(schema).option("basePath", path).parquet(*sorted(files)), text, columns, case_sensitive)
