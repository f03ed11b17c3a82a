"""Every registered query with a SQL check, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import check, connect

ORACLES = entry.oracle_sql()
# Rows-only queries that are compared with NumPy in the other test modules.
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    message, *_ = check(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert not message or message.startswith("NEAR"), message


def test_entry_has_rows_and_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["cohort", "score", "entity", "value"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
