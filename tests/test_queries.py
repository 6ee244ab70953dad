"""Every registered query against its SQL on the small tables."""

import oracle
import pytest

from offerscope import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    assert oracle.compare(QUERIES[name](spark, sf), con, SQL[name]) is None


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
