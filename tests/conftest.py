import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from vantage.session import local_session
    s = local_session(4, shuffle_partitions=8, app_name="vantage-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp(spark):
    """A fresh folder per test (tests only; queries use the shared folder)."""
    return tempfile.mkdtemp(prefix="/tmp/run-")


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return df._jdf.queryExecution().executedPlan().toString()
