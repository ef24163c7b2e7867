"""Registered queries over the given tables, each with an independent SQL oracle."""

from workloads import cataloged, compared, facet, ingested, mapped, summaries  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
