"""The skipping index opens only files that may hold a match, and never misses one."""

import os
import random
import shutil
import time

import pytest

from conftest import SF, rows
from vantage.operators import skipping
from vantage.operators.shaping import search


@pytest.fixture()
def texts(spark, tmp):
    r = random.Random(1)
    data = []
    for i in range(160):
        words = ["".join(r.choices("abcdefghij" if i < 80 else "klmnopqrst", k=5)) for _ in range(6)]
        data.append((i, " ".join(words) + (" Needle-In-Hay" if i == 33 else ""), f"id{i % 5}", i * 1.5, None if i % 3 else "x"))
    path = f"{tmp}/texts"
    (spark.createDataFrame(data, "id int, text string, tag string, price double, note string").repartitionByRange(8, "id")
     .write.parquet(path))
    return path, skipping.build(spark, path, f"{tmp}/index")


def test_only_files_that_may_match_are_read(spark, texts):
    path, index = texts
    got = skipping.search_files(spark, path, index, "needle-in")
    assert rows(got, "id") == [(33,)] and len(got.inputFiles()) == 1
    assert skipping.candidates(spark, path, index, "needle-in").count() == 1
    assert skipping.search_files(spark, path, index, "zzz").count() == 0
    assert skipping.candidates(spark, path, index, "klm", ["text"]).count() <= 5


def test_never_a_miss(spark, texts):
    path, index = texts
    df = spark.read.parquet(path)
    r = random.Random(2)
    every = df.collect()
    needles = ["id3", "Needle", "NEEDLE-in", "12", "2.5", "x", "", "é", "id3 ", "Σx"]
    for _ in range(15):
        t = r.choice(every).text
        i = r.randrange(len(t) - 7)
        needles.append(t[i:i + r.randint(3, 7)])
    for n in needles:
        for sensitive in (False, True):
            got = skipping.search_files(spark, path, index, n, None, sensitive)
            assert rows(got, "id") == rows(search(df, n, None, sensitive), "id"), n
    assert rows(skipping.search_files(spark, path, index, "needle", ["tag"]), "id") == []
    assert rows(skipping.search_files(spark, path, index, "needle", ["text", "note"]), "id") == [(33,)]


def test_new_and_replaced_files_are_read(spark, tmp, texts):
    path, index = texts
    spark.createDataFrame([(900, "fresh needle-in", "t", 1.0, None)], "id int, text string, tag string, price double, note string").coalesce(1).write.parquet(f"{tmp}/new")
    new = next(f for f in os.listdir(f"{tmp}/new") if f.endswith(".parquet"))
    shutil.copyfile(f"{tmp}/new/{new}", f"{path}/part-added.parquet")
    old = sorted(f for f in os.listdir(path) if f.endswith("snappy.parquet"))[-1]
    shutil.copyfile(f"{tmp}/new/{new}", f"{path}/{old}")
    os.remove(f"{path}/.{old}.crc")
    spark.catalog.refreshByPath(path)
    assert rows(skipping.search_files(spark, path, index, "needle-in"), "id") == [(33,), (900,), (900,)]


def test_a_column_that_is_not_indexed(spark, tmp, texts):
    path, _ = texts
    index = skipping.build(spark, path, f"{tmp}/some", ["tag"])
    assert rows(skipping.search_files(spark, path, index, "needle", ["text"]), "id") == [(33,)]
    assert skipping.candidates(spark, path, index, "needle", ["tag"]).count() == 0


def test_documents(spark, tmp):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"{tmp}/do c+s%41ä"
    docs.repartition(6).write.parquet(path)
    index = skipping.build(spark, path, f"{tmp}/docs-index")
    got = skipping.search_files(spark, path, index, "license", ["text", "lang", "source"])
    assert rows(got, "doc_id") == rows(search(docs, "license", ["text", "lang", "source"]), "doc_id")


def test_bitmaps_hold_the_trigrams(spark, tmp):
    texts = ["Ab c\nabc", "\U0001f600ab\U0001f600\U0001f600z", "ab", "", None, "x" * 9 + "\u0085 é"]
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{tmp}/t")
    index = skipping.build(spark, f"{tmp}/t", f"{tmp}/index")
    grams = {t[i:i + 3] for t in (t.lower() for t in texts if t) for i in range(len(t) - 2)}
    bits = spark.createDataFrame([(g,) for g in grams], "gram string").selectExpr(f"pmod(xxhash64(gram), {skipping.BITS}) bit")
    found = {(r.part - 1) * skipping.PART_BITS + 8 * i + j for r in spark.read.parquet(index).where("part IS NOT NULL").collect()
             for i, byte in enumerate(r.bitmap) for j in range(8) if byte >> j & 1}
    assert found == {r.bit for r in bits.collect()}
    assert {len(r.bitmap) for r in spark.read.parquet(index).where("part IS NOT NULL").collect()} == {skipping.PART_BITS // 8}


def test_a_long_text_takes_time_in_proportion(spark, tmp):
    r = random.Random(3)
    text = "".join(r.choices("abcdefgh ", k=600_000)) + " Needle"
    spark.createDataFrame([(1, text), (2, "short")], "id int, text string").coalesce(1).write.parquet(f"{tmp}/long")
    began = time.monotonic()
    index = skipping.build(spark, f"{tmp}/long", f"{tmp}/index", ["text"])
    assert time.monotonic() - began < 20  # minutes when each trigram was sought from the text's start
    assert rows(skipping.search_files(spark, f"{tmp}/long", index, "needle", ["text"]), "id") == [(1,)]
