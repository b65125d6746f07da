import oracle
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    columns, mine, theirs, n = oracle.differences(spark, catalog.QUERIES[name], catalog.SQL[name], SF)
    assert not columns and not mine and not theirs, (columns, mine[:3], theirs[:3])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
