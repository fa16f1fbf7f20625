import pytest

from oracle import compare
from webloom.llm import queries as registered

SQL = registered.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    compare(spark, small, registered.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert registered.queries()[name](spark, small).count() > 0
