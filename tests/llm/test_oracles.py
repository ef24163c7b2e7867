"""Every registered query of the package: against its SQL, or for the rows it must give."""

from __future__ import annotations

import pytest

import corpus_pipeline
from airgauge.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with connection(FOLDER) as c:
        yield c


def test_names():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER) == ""
