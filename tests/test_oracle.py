"""Queries against their SQL on the smallest sample. ORACLE=all runs every query."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle.check import compare, connect
from oracle.sql import ORACLE
from sitequill.queries import QUERIES

SF = "/root/testdata/sf0.001"
QUICK = [
    "lookup_by_slug", "excerpt", "index_listing", "site_index", "html_to_markdown", "safe_markup",
    "agent_names", "valid_ranges", "limit_fixed", "limit_refresh", "redirects", "stale_keys",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample data")


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ORACLE") == "all" else QUICK)
def test_query_equals_sql(spark, name):
    result = compare(spark, connect(SF), name, SF, queries(), oracle_sql())
    assert result.startswith("ok"), result


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
