"""All registered queries against their DuckDB SQL on the smallest tables."""

import os

import pytest

import parity
from fluxgrid.plans import queries
from fluxgrid.plans.oracle import oracle_sql
from fluxgrid.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())


@pytest.fixture(scope="module")
def one_model(spark):
    """The queries of this module share one model, so that its field and events are computed once."""
    make, shared = queries.model, queries.model(spark, DATA)
    queries.model = lambda spark, d, *config: make(spark, d, *config) if config else shared
    yield
    queries.model = make


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, one_model, name):
    assert parity.difference(QUERIES[name](spark, DATA), parity.connection(DATA), oracle_sql()[name]) == ""
