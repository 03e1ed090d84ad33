import os

import pytest

from larder import analytics_queries, catalog_queries, queries, report_queries, service_queries
from tests import oracle

ALL = queries.QUERIES | catalog_queries.QUERIES | analytics_queries.QUERIES | report_queries.QUERIES | service_queries.QUERIES
SQL = queries.ORACLES | catalog_queries.ORACLES | analytics_queries.ORACLES | report_queries.ORACLES | service_queries.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    oracle.same(spark, name, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_runs(spark, name):
    df = ALL[name](spark, oracle.SF)
    rows = df.limit(1000).collect()
    assert rows and any(any(v is not None for v in r) for r in rows), "no query without SQL is empty on the given tables"
