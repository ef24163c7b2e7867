"""Map points: records, even thinning over time, bounds and color scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.operators.running import ONE_TASK_ROWS, running_totals
from airgauge.session import settle

POINT_LIMIT = 6_000


def point_records(rows: DataFrame, category: str, extra: Sequence[str] = ()) -> DataFrame:
    """Located rows with the columns a map point shows."""
    located = rows.where(
        F.col("metric_value").isNotNull()
        & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull()
    )
    return located.select(*S.POINT_COLUMNS, *S.DETAIL_COLUMNS[category], *extra)


def stride_for(total: int, limit: int = POINT_LIMIT) -> int:
    return max(1, -(-total // limit))


def thin_by_time(
    points: DataFrame,
    limit: int = POINT_LIMIT,
    time: str = "measured_at",
    ties: Sequence[str] | None = None,
    total: int | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Every k-th row in time order, k the smallest that leaves ``limit`` rows.

    Rows at the same time are ordered by ``ties`` (all other columns by default), then by
    the columns that are left.

    Only counts are ordered, and one column at a time. Rows are counted for each time, and
    running totals tell which times hold a wanted rank: at most ``limit``. If the rows at
    these are too many for one task, they are counted by the next column of the order as
    well, and so on, until what is left at the wanted keys is wanted whole, is few, or are
    copies of one row. Whole rows are read at the end, for the wanted keys only. So a time
    that holds most rows is spread over tasks like any other.
    """
    if total is None:
        total = points.count()
    stride = stride_for(total, limit)
    order = [time, *_ties(points, time, ties)]
    if stride == 1:
        return points.orderBy(*order).limit(limit)
    order += [c for c in points.columns if c not in order]
    large = total > one_task_rows

    few = max(one_task_rows, limit)  # rows that one task may order
    wanted, keys, largest = None, [], total
    for column in order:
        counts = _counts(points, wanted, keys, column)
        if large and not keys:
            counts = settle(counts)
            largest = counts.count()
        wanted = _narrowed(counts, keys, column, stride, sliced=large and largest > few)
        keys.append(column)
        if not large:
            break
        wanted = settle(wanted)
        left = wanted.agg(F.sum(F.when(F.expr("n > hits"), F.col("n"))).alias("mixed"), F.max("n").alias("largest")).first()
        largest = left.largest or 0
        if (left.mixed or 0) <= few:
            break
    chosen = _rows_at(points, wanted, keys, order[len(keys) :], stride)
    return chosen.select(*points.columns).orderBy(*order).limit(limit)


def _counts(points: DataFrame, wanted: DataFrame | None, keys: Sequence[str], column: str) -> DataFrame:
    """Number of rows for each value of ``column`` at the wanted keys, and the rank of the first row there."""
    rows = points.select(*keys, column)
    if wanted is None:
        rows = rows.withColumn("_before", F.lit(0).cast("bigint"))
    else:
        rows = _at(rows, wanted.select(*keys, F.col("before").alias("_before")), keys)
    return rows.groupBy(*keys, column, "_before").agg(F.count(F.lit(1)).alias("n"))


def _narrowed(counts: DataFrame, keys: Sequence[str], column: str, stride: int, sliced: bool) -> DataFrame:
    """Values of ``keys`` and ``column`` that hold wanted ranks: ``before``, ``n`` and ``hits``."""
    placed = running_totals(counts, [column], "n", groups=keys, sliced=sliced, few_groups=True)
    ranked = placed.withColumn("before", F.col("before") + F.col("_before"))
    found = ranked.withColumn("hits", _hits(stride)).where(F.col("hits") > 0)
    return found.select(*keys, column, "before", "n", "hits")


def _rows_at(
    points: DataFrame, wanted: DataFrame, keys: Sequence[str], rest: Sequence[str], stride: int
) -> DataFrame:
    """The wanted rows among those at the wanted keys."""
    if not rest:  # the keys are whole rows, of which any copies will do
        copies = F.sequence(F.lit(1).cast("bigint"), F.col("hits"))
        return wanted.withColumn("_copy", F.explode(copies))
    near = _at(points, wanted, keys)
    # Of a key that is not wanted whole, some ranks are.
    inside = Window.partitionBy(*keys).orderBy(*rest)
    rank = F.col("before") + F.row_number().over(inside) - 1
    return near.withColumn("_rank", rank).where(F.col("_rank") % stride == 0)


def _at(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows at the given keys, which are no more than the limit; nulls are equal."""
    named = wanted.withColumnsRenamed({k: f"_{k}_" for k in keys})
    same = [rows[k].eqNullSafe(named[f"_{k}_"]) for k in keys]
    return rows.join(F.broadcast(named), same).drop(*[f"_{k}_" for k in keys])


def _hits(stride: int) -> Column:
    """How many multiples of ``stride`` lie in before .. before+n-1."""
    end = F.col("before") + F.col("n")
    k = F.lit(stride)
    return F.floor((end + k - 1) / k) - F.floor((F.col("before") + k - 1) / k)


def _ties(points: DataFrame, time: str, ties: Sequence[str] | None) -> list[str]:
    return list(ties) if ties is not None else [c for c in points.columns if c != time]


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(
        F.min("latitude").alias("south"),
        F.max("latitude").alias("north"),
        F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
    )


def scale_position(value: Column, minimum: Column, maximum: Column) -> Column:
    """Place of a value between two ends, 0 to 1; equal ends count as one apart."""
    span = maximum - minimum
    span = F.when(span == 0, F.lit(1.0)).otherwise(span)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - minimum) / span))


def scale_ticks(summary: DataFrame, ticks: int = 5) -> DataFrame:
    """Evenly spaced values from the minimum to the maximum of a summary row."""
    steps = ticks - 1
    return summary.where(F.col("minimum").isNotNull() & F.col("maximum").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("tick"), "minimum", "maximum"
    ).select(
        "tick",
        (
            F.col("minimum")
            + (F.col("maximum") - F.col("minimum")) * F.col("tick") / F.lit(float(steps))
        ).alias("value"),
    )
