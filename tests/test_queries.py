import pytest
from threadloom import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_equals_sql(name, same_as_sql):
    assert same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name]) >= 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
