"""The registered SQL gives what the queries give, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle  # noqa: E402

from lookupforge.llm import queries as Q  # noqa: E402


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, sf_dir, name):
    assert oracle.compare(Q.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), Q.SQL[name]) is None
