"""Every registered query against its DuckDB oracle on the driver tables."""

import pytest

from conftest import MEDIUM, SMALL
from ledgerlens.plans.catalog import QUERIES
from oracle.compare import compare, duck_connection
from oracle.queries import oracle_sql

SQL = oracle_sql()
FLAGSHIPS = ["cohort_retention", "churn_status", "paying_users", "conversion_funnel",
             "payments_extended"]


@pytest.fixture(scope="module")
def duck_small():
    return duck_connection(SMALL)


@pytest.fixture(scope="module")
def duck_medium():
    return duck_connection(MEDIUM)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert len(QUERIES) == 42


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle_small(spark, duck_small, name):
    result = compare(QUERIES[name](spark, SMALL), duck_small, SQL[name])
    assert result["match"], result


@pytest.mark.parametrize("name", FLAGSHIPS)
def test_matches_oracle_medium(spark, duck_medium, name):
    result = compare(QUERIES[name](spark, MEDIUM), duck_medium, SQL[name])
    assert result["match"], result
