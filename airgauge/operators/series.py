"""Time-bucketed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES_BUCKETS = 500

# Bucket widths in seconds.
BUCKET_WIDTHS = (
    1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800,
    3600, 7200, 14400, 21600, 43200, 86400,
)


def bucket_width(seconds: float) -> int:
    """Narrowest width that keeps the series near the wanted number of buckets."""
    needed = max(1.0, max(0.0, seconds) / SERIES_BUCKETS)
    fitting = [w for w in BUCKET_WIDTHS if w >= needed]
    return fitting[0] if fitting else BUCKET_WIDTHS[-1]


def bucket_width_of(seconds: Column) -> Column:
    """The same choice as a column."""
    needed = F.greatest(F.lit(1.0), seconds / F.lit(float(SERIES_BUCKETS)))
    widths = F.array(*[F.lit(w) for w in BUCKET_WIDTHS])
    return F.coalesce(
        F.try_element_at(F.filter(widths, lambda w: w >= needed), F.lit(1)),
        F.lit(BUCKET_WIDTHS[-1]),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Length of a zone-free time span in seconds."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0)


def time_series(rows: DataFrame, seconds: int, value: str = "metric_value") -> DataFrame:
    """Average, extremes and number of values for each time bucket."""
    bucket = F.window("measured_at", f"{seconds} seconds")
    return (
        rows.where(F.col(value).isNotNull())
        .groupBy(bucket.alias("w"))
        .agg(
            F.avg(value).alias("average"),
            F.min(value).alias("minimum"),
            F.max(value).alias("maximum"),
            F.count(value).alias("samples"),
        )
        .select(F.col("w.start").alias("bucket"), "average", "minimum", "maximum", "samples")
    )


def series_extent(series: DataFrame) -> DataFrame:
    return series.agg(F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"))
