"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.session import shared_path

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library: hand Spark one zip of it per
    application (as ``--py-files`` does; Spark itself serves it to executors)."""
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "vantage.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: cuts the
    lineage at a table that a lost executor cannot take with it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str, m: int) -> Column:
    """``crc32(col as text) mod m``; null ids give null."""
    return F.crc32(F.col(col).cast("string")) % m


def flag(cond: Column) -> Column:
    """A boolean that is false, not null, where the condition is unknown."""
    return F.coalesce(cond, F.lit(False))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def meet(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has each key once and ``n``, the rows of ``left`` that have it. Keys with
    1 / ``share`` of the rows or more (``share`` of them at most) meet their rows in a broadcast join, the
    others in a shuffle that then has no large group."""
    total = left.count()
    heavy = F.broadcast(right.where(F.col("n") * share >= total).drop("n"))
    light = right.where(F.col("n") * share < total).drop("n")
    return left.join(heavy, key).unionByName(left.join(heavy.select(key), key, "left_anti").join(light, key))


def even_share(column: str, sizes: dict, most: float) -> Column:
    """The share of the rows of each value of ``column`` to take (``sizes``: rows by value), so that about ``most`` are
    taken in all: of each value as many, or all of a rarer one, whose rest the others share."""
    each = most / max(1, len(sizes))
    spare = sum(max(0.0, each - n) for n in sizes.values())
    large = {v: n for v, n in sizes.items() if n > each}
    share = F.lit(1.0)
    for value, n in large.items():
        share = F.when(F.col(column) == value, min(1.0, (each + spare / len(large)) / n)).otherwise(share)
    return share


class Boxed:
    """A table's other columns put away while an operator works on the ``needed`` ones, so that no
    column of a caller can clash with the operator's own names: ``docs`` has the needed columns and
    one struct; ``open(df)`` gives all columns back as they were."""

    def __init__(self, docs: DataFrame, *needed: str):
        self.columns, self.name = docs.columns, "box"
        others = [c for c in docs.columns if c not in needed]
        self.fields = {c: f"{self.name}.c{i}" for i, c in enumerate(others)}
        box = F.struct(*(docs[_quoted(c)].alias(f"c{i}") for i, c in enumerate(others)), F.lit(None).cast("int").alias("end"))
        self.docs = docs.select(*(docs[_quoted(c)] for c in needed), box.alias(self.name))

    def open(self, df: DataFrame, *more: Column) -> DataFrame:
        return df.select(*(F.col(self.fields.get(c, c)).alias(c) for c in self.columns), *more)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class HashCache(dict):
    """Word (bytes) -> 64-bit hash, kept per task up to a size bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased (a bytes
    ``lower`` and ``split`` touch ASCII alone). Null has no words."""
    return text.lower().split() if text else []


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a full URI of the file system that Spark takes it to be on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def file_system(uri: str):
    """pyarrow's file system and the path on it, for code inside tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)
