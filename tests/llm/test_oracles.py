"""The operators' queries that SQL can express, against DuckDB on the smallest tables."""

import pytest
from tests.compare import differences

from corpusmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == ""
