"""One broken file is named, the others are counted."""

import gzip
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import SF
from vantage.catalog import Catalog
from vantage.operators.fileprobe import listing, probe_files
from vantage.operators.health import diagnose, diagnose_files


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture()
def broken(spark, tmp):
    """Orders in five Parquet files: one cut short, one overwritten in the middle, one of no rows."""
    spark.read.parquet(f"{SF}/orders.parquet").repartition(4).write.parquet(f"{tmp}/orders")
    files = sorted(f"{tmp}/orders/{f}" for f in os.listdir(f"{tmp}/orders") if f.endswith(".parquet"))
    rows = {f: pq.ParquetFile(f).metadata.num_rows for f in files}
    size = os.path.getsize(files[0])
    os.truncate(files[0], size // 2)
    start = pq.ParquetFile(files[1]).metadata.row_group(0).column(3).data_page_offset
    with open(files[1], "r+b") as f:  # the middle of a column's page: its footer stays whole
        f.seek(start)
        f.write(b"\xff" * 600)
    table = pq.read_table(files[2])
    pq.write_table(table.slice(0, 0), f"{tmp}/orders/empty.parquet")
    for f in os.listdir(f"{tmp}/orders"):
        if f.endswith(".crc"):
            os.remove(f"{tmp}/orders/{f}")
    cat = Catalog(spark)
    cat.register("wh", "parquet", files=[f"{tmp}/orders", f"{SF}/nation.parquet"])
    return cat, files, rows


def test_broken_parquet_files_are_named(broken):
    cat, files, rows = broken
    got = {os.path.basename(r.file): r for r in diagnose_files(cat).collect() if r.table == "orders"}
    assert len(got) == 5
    names = [os.path.basename(f) for f in files]
    assert not got[names[0]].ok and got[names[0]].message == "no readable footer" and got[names[0]].n_rows == 0
    assert not got[names[1]].ok and got[names[1]].message == f"{got[names[1]].n_rows} of {rows[files[1]]} rows readable"
    for f in names[2:]:
        assert got[f].ok and got[f].message == "ok"
    assert [got[f].n_rows for f in names[2:]] == [rows[f] for f in files[2:]]
    assert got["empty.parquet"].ok and got["empty.parquet"].n_rows == 0


def test_tables_beside_a_broken_one(broken):
    cat, files, rows = broken
    got = {r.table: r for r in diagnose(cat, mode="read").collect()}
    assert (got["nation"].ok, got["nation"].message, got["nation"].n_rows) == (True, "ok", 25)
    assert not got["orders"].ok and got["orders"].message == "2 of 5 files unreadable"
    assert got["orders"].n_rows >= rows[files[2]] + rows[files[3]]


def test_a_table_without_any_readable_file(spark, tmp):
    for k in range(2):
        write(f"{tmp}/bad/{k}.parquet", "no parquet at all")
    cat = Catalog(spark)
    cat.register("x", "parquet", files=[f"{tmp}/bad", f"{tmp}/missing"])
    got = {(r.table, r.file and os.path.basename(r.file)): (r.ok, r.message) for r in diagnose_files(cat).collect()}
    assert got == {("bad", "0.parquet"): (False, "no readable footer"), ("bad", "1.parquet"): (False, "no readable footer"),
                   ("missing", None): (False, "missing")}


def test_csv_and_json_files(spark, tmp):
    write(f"{tmp}/c/a.csv", "x,y\n1,a\n2,b\n")
    write(f"{tmp}/c/b.csv", "x,y\n1,a,9\nq,b\n3,c\n")
    write(f"{tmp}/c/head.csv", "x,y\n")
    write(f"{tmp}/j/a.json", '{"x": 1}\n{"x": 2}\n')
    write(f"{tmp}/j/b.json", '{"x": 1}\n{"x": \n')
    with open(f"{tmp}/j/c.json.gz", "wb") as f:
        f.write(gzip.compress("".join(json.dumps({"x": i}) + "\n" for i in range(10)).encode())[:20])
    with open(f"{tmp}/j/d.json.gz", "wb") as f:  # two members
        f.write(b"".join(gzip.compress("".join(json.dumps({"x": i}) + "\n" for i in range(5)).encode()) for _ in range(2)))
    cat = Catalog(spark)
    cat.register("c", "csv", files=[f"{tmp}/c"], schemas={"c": "x INT, y STRING"})
    cat.register("j", "json", files=[f"{tmp}/j"])
    got = {os.path.basename(r.file): (r.ok, r.message, r.n_rows) for r in diagnose_files(cat).collect()}
    assert got == {"a.csv": (True, "ok", 2), "b.csv": (False, "2 malformed records", 1), "head.csv": (True, "ok", 0),
                   "a.json": (True, "ok", 2), "b.json": (False, "1 malformed records", 1),
                   "c.json.gz": (False, "compressed stream is broken", 1), "d.json.gz": (True, "ok", 10)}


def test_checksums_do_not_depend_on_the_files_order(spark, tmp):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    o.coalesce(1).write.parquet(f"{tmp}/a")
    o.orderBy("o_custkey", "o_orderkey").coalesce(1).write.parquet(f"{tmp}/b")
    o.where("o_orderkey > 1").coalesce(1).write.parquet(f"{tmp}/c")
    cat = Catalog(spark)
    cat.register("x", "parquet", files=[f"{tmp}/{k}" for k in "abc"])
    a, b, c = (probe_files(spark, cat.connection("x"), k).first().checksum for k in "abc")
    assert a == b != c


def test_maps_and_nested_columns_are_read(spark, tmp):
    df = spark.createDataFrame([(1, {"a": 1}, {"m": {"b": 2}})], "id int, m map<string,int>, s struct<m: map<string,int>>")
    df.write.parquet(f"{tmp}/m")
    pa.table({"k": [1]})
    cat = Catalog(spark)
    cat.register("x", "parquet", files=[f"{tmp}/m"])
    row = probe_files(spark, cat.connection("x"), "m").where("n_rows > 0").first()
    assert row.ok and row.n_rows == 1 and row.bytes > 0
    assert listing(spark, f"{tmp}/m").count() >= 1
