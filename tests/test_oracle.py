"""Every registered query against its SQL on the smallest tables."""

import pytest

import oracle
from sieveline.plans import registry

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"linked_documents", "anchor_copy", "stopped_emails", "delivery_sync", "nudge_due", "open_anti"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_agrees_with_sql(spark, con, name):
    found = oracle.difference(spark, con, name, registry.QUERIES[name], registry.SQL[name], SF)
    assert found is None or (found.endswith("both empty") and name in MAY_BE_EMPTY), found


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
