"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from checks import compare, registry

QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    got, want, _, verdict = compare.compare(spark, con, sf, name, QUERIES[name], SQL.get(name))
    assert verdict in ("same", "no sql"), verdict
    assert got


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r.provider for r in rows] and rows == sorted(rows, key=lambda r: (-r.requests, r.provider))
