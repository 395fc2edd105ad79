"""Versioned copies in the shared folder."""

import os
import shutil
import uuid

import pytest

from conftest import SF, rows
from vantage.catalog import Catalog
from vantage.operators import snapshots


@pytest.fixture()
def landed(spark, tmp):
    """Orders in three files, under a connection name of its own."""
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderstatus")
    for k in "FOP":
        o.where(f"o_orderstatus = '{k}'").coalesce(1).write.parquet(f"{tmp}/orders/{k}")
    cat = Catalog(spark)
    name = "landed" + uuid.uuid4().hex[:8]
    cat.register(name, "parquet", files=[f"{tmp}/orders"], read_options={"recursiveFileLookup": True})
    return cat, name, o


def replace(spark, tmp, key, df):
    shutil.rmtree(f"{tmp}/orders/{key}")
    df.coalesce(1).write.parquet(f"{tmp}/orders/{key}")


def test_only_changed_files_are_copied(spark, tmp, landed):
    cat, name, o = landed
    one = snapshots.refresh(cat, name, "orders")
    assert one.number == 1 and rows(one.read()) == rows(o)
    assert snapshots.refresh(cat, name, "orders") == one and not snapshots.is_stale(cat, name, "orders")
    replace(spark, tmp, "P", o.where("o_orderkey < 0"))  # a file of no rows
    replace(spark, tmp, "F", o.where("o_orderstatus = 'F' AND o_orderkey > 100"))
    assert snapshots.is_stale(cat, name, "orders")
    changed = one.changes(snapshots.state(cat, name, "orders")).groupBy("change").count().collect()
    assert {r.change: r["count"] for r in changed} == {"added": 2, "removed": 2}  # part files have new names
    two = snapshots.refresh(cat, name, "orders")
    assert rows(two.read()) == rows(o.where("o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_orderkey > 100"))
    assert rows(one.read()) == rows(o)  # pinned
    old = {r.file: r.folder for r in one.manifest().collect()}
    new = {r.file: r.folder for r in two.manifest().collect()}
    assert [old[f] for f in old if f in new] == [new[f] for f in new if f in old] and len(new) == 3
    written = os.listdir(f"{two.folder}/data/{two.version.split('-')[1]}".removeprefix("file:"))
    assert len([w for w in written if w.startswith("__source")]) == 1  # F; O was taken over, P has no rows


def test_a_file_changed_in_place_is_seen(spark, tmp, landed):
    cat, name, o = landed
    one = snapshots.refresh(cat, name, "orders")
    folder = f"{tmp}/orders/O"
    part = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    o.where("o_orderkey = 1").coalesce(1).write.parquet(f"{tmp}/new")
    new = next(f for f in os.listdir(f"{tmp}/new") if f.endswith(".parquet"))
    shutil.copyfile(f"{tmp}/new/{new}", f"{folder}/{part}")
    os.remove(f"{folder}/.{part}.crc")
    assert [r.change for r in one.changes(snapshots.state(cat, name, "orders")).collect()] == ["changed"]
    two = snapshots.refresh(cat, name, "orders")
    assert two.read().count() == o.where("o_orderstatus <> 'O'").count() + 1


def test_copies_outlive_the_session(spark, tmp, landed):
    cat, name, o = landed
    snapshots.refresh(cat, name, "orders")
    other = Catalog(spark.newSession(), snapshots="fresh")
    other.register(name, "parquet", files=[f"{tmp}/orders"], read_options={"recursiveFileLookup": True})
    got = other.scan(name, "orders")
    assert all("/snapshots/" in f for f in got.inputFiles()) and rows(got) == rows(o)
    replace(spark, tmp, "P", o.where("o_orderstatus = 'P' AND o_orderkey > 5"))
    other.refresh()
    stale = other.scan(name, "orders")
    assert not any("/snapshots/" in f for f in stale.inputFiles())
    assert stale.count() == o.where("o_orderstatus <> 'P' OR o_orderkey > 5").count()
    keep = Catalog(spark, snapshots="any")
    keep.register(name, "parquet", files=[f"{tmp}/orders"])
    assert keep.scan(name, "orders").count() == o.count()


def test_a_refresh_that_dies_leaves_no_version(spark, tmp, landed, monkeypatch):
    cat, name, o = landed
    one = snapshots.refresh(cat, name, "orders")
    replace(spark, tmp, "P", o.where("o_orderstatus = 'P' AND o_orderkey > 5"))

    def dies(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(snapshots, "_counts", dies)
    with pytest.raises(RuntimeError):
        snapshots.refresh(cat, name, "orders")
    os.makedirs(f"{one.folder}/versions/0000000009-torn".removeprefix("file:"))  # a manifest without its marker
    assert snapshots.latest(spark, one.folder) == one
    monkeypatch.undo()
    two = snapshots.refresh(cat, name, "orders")
    assert two.number == 2 and two.read().count() == o.where("o_orderstatus <> 'P' OR o_orderkey > 5").count()
    assert snapshots.vacuum(spark, one.folder, keep=1) == 1  # the torn refresh's data; the first one's is in use
    assert two.read().count() == o.where("o_orderstatus <> 'P' OR o_orderkey > 5").count()


def test_a_new_shape_copies_everything(spark, tmp, landed):
    cat, name, o = landed
    one = snapshots.refresh(cat, name, "orders")
    cat.register(name, "parquet", files=[f"{tmp}/orders"],
                 read_options={"recursiveFileLookup": True}, schemas={})
    wide = o.withColumn("extra", o.o_orderkey * 2)
    for k in "FOP":
        replace(spark, tmp, k, wide.where(f"o_orderstatus = '{k}'"))
    two = snapshots.refresh(cat, name, "orders")
    assert two.read().columns == ["o_orderkey", "o_orderstatus", "extra"] and one.read().columns == o.columns
    assert rows(two.read()) == rows(wide)
