import pytest

from corelake.plans import queries as q

from .conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = q.queries()[name](spark, SMALL).toPandas()
    assert same(duck.execute(q.oracle_sql()[name]).df(), found)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(q.queries().keys() - q.oracle_sql().keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert q.queries()[name](spark, SMALL).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
