"""Every registered query outside the optional subpackage against its SQL, and the schema of the rest."""

import pytest

from tallywright import suite
from tests.compare import spark_rows, sql_rows
from tests.conftest import SF

QUERIES, SQL = suite.queries(), suite.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(SQL[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(suite.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
