"""Every query that SQL can express, next to its SQL."""

import pytest

from moodtide.queries import ORACLES, QUERIES
from tools.compare import connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf))
    expected_columns, expected = sql_rows(duck, ORACLES[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["lang", "kept", "words_left"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
