"""Every registered query of the library against its SQL, and the driver contract."""

from __future__ import annotations

import pytest

from millrace.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.tables(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, con, name):
    oracle.assert_same(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "metric", "k", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
