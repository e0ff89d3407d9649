"""Every core query against its SQL on the smallest tables."""

import pytest

from ferrule.plans.catalog import registries
from tests.oracle import compare, connect

QUERIES = {n: q for r in registries() for n, q in r.queries.items()}
SQL = {n: s for r in registries() for n, s in r.sql.items()}


#: The tables hold no routes and no commands; these are tested in test_relations.py.
NOTHING_IN_THE_TABLES = {"http_routes", "route_tree", "command_tree"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, con):
    if name in SQL:
        assert compare(name, QUERIES[name], SQL[name], spark, small, con) is None
    else:
        n = QUERIES[name](spark, small).count()
        assert n == 0 if name in NOTHING_IN_THE_TABLES else n > 0
