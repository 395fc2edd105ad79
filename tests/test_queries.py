"""Every registered query against its DuckDB oracle on the smallest data."""

import datetime as dt
import decimal
import math
import os
import shutil

import duckdb
import pyarrow.parquet as pq
import pytest

from conftest import SF
from __spark_entry__ import entry, oracle_sql, queries
from vantage.plans.oracle import ALL_TABLES
from vantage.plans.registry import QUERIES


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v).lower() if isinstance(v, bool) else str(v)


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert canon(got, df.columns) == canon(want, ocols)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["r_name", "n_name", "n_lines", "revenue"]
    assert df.count() > 0


def test_bucketed_join_sees_changed_files(spark, tmp):
    shutil.copytree(SF, f"{tmp}/sf", copy_function=shutil.copyfile, ignore=shutil.ignore_patterns("lineitem*"))
    os.chmod(f"{tmp}/sf", 0o755)  # the given folder may be read-only, and copytree keeps its mode
    shutil.copyfile(f"{SF}/lineitem.parquet", f"{tmp}/sf/lineitem.parquet")
    run = queries()["bucketed_join"]
    before = sum(r.n_lines for r in run(spark, f"{tmp}/sf").collect())
    pq.write_table(pq.read_table(f"{SF}/lineitem.parquet").slice(0, 10), f"{tmp}/sf/lineitem.parquet")
    assert sum(r.n_lines for r in run(spark, f"{tmp}/sf").collect()) == 10 < before
