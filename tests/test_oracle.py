import pytest

import oracle
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(oracle.entry_module.catalog.SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, SF, name) is None


def test_every_query_has_sql():
    assert set(oracle.entry_module.catalog.SQL) == set(oracle.entry_module.catalog.QUERIES)


def test_entry_has_rows(spark):
    df = oracle.entry_module.entry(spark)
    assert len(df.columns) == 20 and df.count() == 1000
