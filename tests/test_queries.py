import pytest
from conftest import SF

from grovecut.plans import queries as Q


@pytest.mark.parametrize("name", Q.SQL)
def test_query_equals_its_sql(spark, same_as_sql, name):
    same_as_sql(Q.QUERIES[name](spark, SF), Q.SQL[name])


def test_entry_imports_and_lists_queries():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_order_only_splits_groups(spark):
    fixed, free = (Q.counted(fixed=f)(spark, SF).agg({"number": "sum"}).head()[0] for f in (True, False))
    assert fixed == free
