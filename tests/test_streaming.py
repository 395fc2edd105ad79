import os

from conftest import SF
from vantage.catalog import Catalog
from vantage.operators.predicates import FilterSpec
from vantage.streaming import ingest, watch


def test_incremental_ingest_picks_up_only_new_files(spark, tmp):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    folder = os.path.join(tmp, "uploads", "orders")
    o.filter("o_orderkey % 2 = 0").write.parquet(os.path.join(folder, "batch1"))
    cat = Catalog(spark)
    cat.register("up", "parquet", files=[folder])
    target, ckpt = os.path.join(tmp, "out"), os.path.join(tmp, "ckpt")
    flt = [FilterSpec("equal", "o_orderstatus", "F")]
    stream = lambda: watch(cat, "up", "orders", flt, schema=o.schema)
    ingest(stream(), target, checkpoint=ckpt)
    first = spark.read.parquet(target).count()
    assert first == o.filter("o_orderkey % 2 = 0 AND o_orderstatus = 'F'").count()
    o.filter("o_orderkey % 2 = 1").write.parquet(os.path.join(folder, "batch2"))
    ingest(stream(), target, checkpoint=ckpt)
    out = spark.read.parquet(target)
    want = o.filter("o_orderstatus = 'F'")
    assert out.count() == want.count()
    assert out.exceptAll(want).count() == 0


def test_payload_folder_stream(spark, tmp):
    import json
    folder = os.path.join(tmp, "payloads")
    os.makedirs(folder)
    with open(os.path.join(folder, "p1.json"), "w") as f:
        json.dump([{"id": 1, "u": {"n": "a"}}, {"id": 2, "u": {"n": "b"}}], f)
    cat = Catalog(spark)
    cat.register("web", "api", files=[folder])
    schema = "id long, u struct<n: string>"
    target, ckpt = os.path.join(tmp, "out"), os.path.join(tmp, "ckpt")
    ingest(watch(cat, "web", "payloads", schema=schema), target, checkpoint=ckpt)
    with open(os.path.join(folder, "p2.json"), "w") as f:
        json.dump({"id": 3, "u": {"n": "c"}}, f)
    ingest(watch(cat, "web", "payloads", schema=schema), target, checkpoint=ckpt)
    got = sorted((r.id, r.u_n) for r in spark.read.parquet(target).collect())
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_an_upload_replaces_the_one_of_its_name(spark, tmp):
    from vantage.operators import snapshots
    from vantage.streaming import ingest_replacing
    folder, target, ckpt = os.path.join(tmp, "up"), os.path.join(tmp, "copy"), os.path.join(tmp, "ckpt")

    def upload(batch, name, keys, at):
        os.makedirs(f"{folder}/{batch}", exist_ok=True)
        with open(f"{folder}/{batch}/{name}.csv", "w") as f:
            f.write("k,v\n" + "".join(f"{k},{batch}\n" for k in keys))
        os.utime(f"{folder}/{batch}/{name}.csv", (at, at))
    cat = Catalog(spark)
    cat.register("up", "csv", files=[folder])

    def run():
        ingest_replacing(watch(cat, "up", "up", schema="k int, v string"), target, checkpoint=ckpt)
        newest = snapshots.latest(spark, target)
        return newest, sorted((r.k, r.v) for r in newest.read().collect())
    upload("b1", "a", [1, 2], 1_700_000_000)
    upload("b1", "b", [3], 1_700_000_000)
    first, got = run()
    assert got == [(1, "b1"), (2, "b1"), (3, "b1")]
    upload("b2", "a", [1, 9], 1_700_000_100)
    upload("b0", "b", [7], 1_600_000_000)  # older than what is there: no news
    second, got = run()
    assert got == [(1, "b2"), (3, "b1"), (9, "b2")]
    assert sorted((r.k, r.v) for r in first.read().collect()) == [(1, "b1"), (2, "b1"), (3, "b1")]  # a pinned reader
    again, got = run()  # nothing new
    assert again == second and got == [(1, "b2"), (3, "b1"), (9, "b2")]
    # a batch that Spark runs again, from an empty checkpoint's view: the same number, committed before
    ingest_replacing(watch(cat, "up", "up", schema="k int, v string"), target, checkpoint=ckpt + "2")
    assert snapshots.latest(spark, target) == second
