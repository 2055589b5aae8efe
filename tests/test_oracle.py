"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

import pytest
from compare import compare, connect
from conftest import SMALL

from almagest.plans.oracle import ORACLE
from almagest.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SMALL, name, QUERIES[name], ORACLE.get(name))
    assert ok, text


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)
