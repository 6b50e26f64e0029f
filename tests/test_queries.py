"""Every engine query against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from lookupforge.plans import queries as Q  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf_dir, con, name):
    assert oracle.compare(Q.QUERIES[name](spark, sf_dir), con, Q.SQL[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(Q.QUERIES) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 3


def test_scans_read_what_they_need(spark, sf_dir):
    """The flagship reads three columns of lineitem and two of embeddings, and never gathers lists."""
    plan = Q.QUERIES["lookup_mean"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "collect_list" not in plan and "Python" not in plan and "CartesianProduct" not in plan
