"""Plan shape of every registered query: no pairs-emitting joins, no
row-at-a-time Python, pushdown and pruning where the operator promises them."""

import pytest

from conftest import SF, plan
from __spark_entry__ import queries
from vantage.plans.registry import QUERIES

# key paths are walked by an Arrow function: texts in batches, one pass a document
PYTHON_OK = {"json_keypaths", "json_keypaths_nested", "json_keypaths_deep", "json_keypaths_combined"}


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(queries()[name](spark, SF)) for name in QUERIES}


def test_no_cross_products(plans):
    bad = [n for n, p in plans.items()
           if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_no_row_at_a_time_python(plans):
    assert [n for n, p in plans.items() if "BatchEvalPython" in p] == []
    py = {n for n, p in plans.items() if "Python" in p or "ArrowEvalPython" in p}
    assert py <= PYTHON_OK


def test_filters_push_down(plans):
    for name in ("filter_equal_int", "filter_equal_double", "filter_contains",
                 "filter_starts_with", "filter_ends_with", "filter_set",
                 "filter_equal_timestamp"):
        pushed = plans[name].split("PushedFilters: [", 1)[1].split("]", 1)[0]
        assert any(op in pushed for op in ("EqualTo(", "StringContains(", "GreaterThanOrEqual(")), name
    assert "EqualTo(o_orderstatus,F)" in plans["filter_set"]
    assert "StringStartsWith(o_orderpriority,1-)" in plans["filter_set"]


def test_projection_prunes(plans):
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plans["project"]
    assert "ReadSchema: struct<>" in plans["catalog_tables"]


def test_previews_are_top_k(plans):
    for name in ("sort_preview", "sort_nulls_preview", "ws_topk"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_bucketed_join_reads_without_shuffle(plans):
    p = plans["bucketed_join"]
    below_join = p.split("SortMergeJoin", 1)[1]
    assert "Bucketed: true" in below_join and "Exchange" not in below_join
