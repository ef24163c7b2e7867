"""Paths as Spark's readers take and give them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_safe(path: str) -> str:
    """Path with the characters escaped that a reader would take as a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def plain_path(encoded: Column) -> Column:
    """Path of a file as listed, from the URL-encoded form of reader metadata."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
