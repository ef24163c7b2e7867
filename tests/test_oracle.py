"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import pytest

from tests.oracle import compare, connection
from workloads import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with connection(FOLDER) as c:
        yield c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER)
    # A selection may find nothing in so few rows; equal is enough.
    assert problem in ("", f"{name}: no rows"), problem
