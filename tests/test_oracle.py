"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    if name in ORACLE:
        assert compare.difference(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["role_category", "median_salary"]
