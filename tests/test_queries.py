"""Every query against its SQL, and those without SQL for rows, at the smallest size."""

import pytest
from compare import differences, oracle

from motifgrid.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_query_matches_sql(spark, name):
    assert differences(catalog.QUERIES[name](spark, DATA), oracle(DATA), catalog.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
