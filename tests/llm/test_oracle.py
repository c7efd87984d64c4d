"""Training-data queries against their SQL at the smallest size."""

import pytest
from compare import differences, oracle

from motifgrid.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE)
def test_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DATA), oracle(DATA), queries.ORACLE[name]) == ""
