"""The registered queries beside their SQL."""

import pytest

from lexmill.llm import queries
from tests.comparing import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_those_of_the_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) == ""
