import pytest
from llm_duck import duck, same_rows

from pagecurate.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, name, sf):
    d = f"/root/testdata/sf{sf}"
    assert same_rows(queries.QUERIES[name](spark, d), duck(d), queries.ORACLE[name]) > 0
