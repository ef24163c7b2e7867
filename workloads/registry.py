"""Collects the registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workloads.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ("m",)):
    """Register a query; ``sql`` may use the fixture views in ``views``."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return function

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded as far as two engines can be expected to agree."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})
