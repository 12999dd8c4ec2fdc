"""Registered queries of the subpackage against their SQL."""

from __future__ import annotations

import pytest

from panewise.llm.queries import QUERIES, SQL
from tests.oracle import DATA, started


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")) == list(range(1, 14))


@pytest.fixture(scope="module")
def outcomes(spark, request):
    yield from started(spark, request, QUERIES, SQL)


@pytest.mark.skipif(not DATA.exists(), reason="no generated tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(outcomes, name):
    outcomes[name].result()
