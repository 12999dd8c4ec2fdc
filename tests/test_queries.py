"""Registered queries of the engine against their SQL."""

from __future__ import annotations

import pytest

from panewise import chains, queries
from tests.oracle import DATA, started

QUERIES, SQL = {**queries.QUERIES, **chains.QUERIES}, {**queries.SQL, **chains.SQL}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.fixture(scope="module")
def outcomes(spark, request):
    yield from started(spark, request, QUERIES, SQL)


@pytest.mark.skipif(not DATA.exists(), reason="no generated tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(outcomes, name):
    outcomes[name].result()
