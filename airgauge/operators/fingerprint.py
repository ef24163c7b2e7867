"""Partition summaries and order-independent content fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgauge import schema as S


# Part of every fingerprint; raised when the text of a row changes.
TEXT_VERSION = 2


def row_text(columns: Sequence[str]) -> Column:
    """A row as JSON text with NULL fields kept and times in full, to the microsecond."""
    full = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"ignoreNullFields": "false", "timestampNTZFormat": full, "timestampFormat": full + "XXX"}
    return F.to_json(F.struct(*columns), options)


def md5_halves(text: Column) -> tuple[Column, Column]:
    """Two 60-bit numbers taken from the MD5 of a text."""
    digest = F.md5(text)

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")

    return part(1), part(16)


def partition_summaries(
    rows: DataFrame, keys: Sequence[str], text: Column, *more: Column
) -> DataFrame:
    """Row count, time span, checksums and ``more`` aggregates of each partition.

    Sums and XORs do not depend on row order and combine before the shuffle, so a
    partition of any size costs the final task one row from each input task.
    """
    lower, upper = md5_halves(text)
    hashed = rows.withColumns({"_lower": lower, "_upper": upper})
    wide = "decimal(38,0)"
    return hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("measured_at").alias("start_time"),
        F.max("measured_at").alias("end_time"),
        F.sum(F.col("_lower").cast(wide)).alias("lower_sum"),
        F.bit_xor("_lower").alias("lower_xor"),
        F.sum(F.col("_upper").cast(wide)).alias("upper_sum"),
        F.bit_xor("_upper").alias("upper_xor"),
        *more,
    )


def fingerprint(kind: Column, columns: Column) -> Column:
    """SHA-256 over schema and text version, kind, columns and a partition summary."""
    parts = F.concat_ws(
        "|",
        F.lit(f"{S.SCHEMA_VERSION}.{TEXT_VERSION}"),
        kind,
        columns,
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("-"))
            for c in (
                "row_count", "start_time", "end_time",
                "lower_sum", "lower_xor", "upper_sum", "upper_xor",
            )
        ],
    )
    return F.sha2(parts, 256)
