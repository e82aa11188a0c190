"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import difference, duck
from conftest import SF_DIR

from casefeat.catalog import entry, oracle_sql, queries

NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(NAMES) == set(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert difference(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["case_id", "rel_d", "token", "weight"]
    assert df.count() > 0
