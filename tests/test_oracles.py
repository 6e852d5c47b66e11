"""Every reference query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from sitelore.plans import catalog

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(name, compare):
    assert compare(catalog.QUERIES[name], catalog.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
