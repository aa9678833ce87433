import pytest
from oracle import connect, same

from rosterloom.plans import registry
from rosterloom.session import intermediates

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, con, name):
    with intermediates():
        same(registry.queries()[name](spark, data), con, SQL[name])


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
