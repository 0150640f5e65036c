"""Every registered query of the reference's operators against DuckDB, or that it runs."""

import pytest

from tessera.plans import catalog, expressions, relations  # noqa: F401
from tessera.plans.registered import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert_same(df, con, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
