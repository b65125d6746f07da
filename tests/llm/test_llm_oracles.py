import oracle
import pytest

from tidemark.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    columns, mine, theirs, n = oracle.differences(spark, llm.queries()[name], llm.oracle_sql()[name], "/root/testdata/sf0.001")
    assert not columns and not mine and not theirs and n
