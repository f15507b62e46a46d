"""Every registered query against its SQL, and entry points."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from tables_in_use import SF

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        result = compare(spark, con, QUERIES[name], ORACLES[name], SF)
        assert result.startswith("ok"), result
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
