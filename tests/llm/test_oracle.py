import pytest

from linewright.llm import queries

from ..conftest import SF
from ..oracle_compare import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_and_its_sql(spark, name):
    a, b, x, y = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])
    assert a == b > 0 and not x and not y
