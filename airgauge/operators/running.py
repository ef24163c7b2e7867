"""Running totals over a global order, without a task that sees every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgauge.session import broadcast_if_small, settle

# Above this many rows a global order is cut into slices over all executors.
# Below it the (narrow) rows of one group are ordered in one task.
ONE_TASK_ROWS = 2_000_000


def running_totals(
    rows: DataFrame,
    order: Sequence[str],
    weight: str,
    groups: Sequence[str] = (),
    sliced: bool = True,
    few_groups: bool = False,
) -> DataFrame:
    """Add ``before``, the weight of all earlier rows of the group, and its ``total``.

    ``order`` must be unique within a group. The sliced form range-partitions on
    (groups, order), so even a group that holds most rows is spread over many
    tasks. The slice number is written down with the rows before it is used: a
    lost executor can then not lead to a second, different slicing. Only one
    total for each (slice, group) is shared between tasks. Slices are contiguous,
    so there are fewer of these than slices plus groups: without groups no more
    than shuffle partitions, with groups they are counted before a broadcast, unless the
    caller knows that there are ``few_groups``.
    """
    keys = [*groups, *order]
    if not sliced:
        group = Window.partitionBy(*(groups or [F.lit(0)]))
        return rows.withColumns(
            {
                "before": _earlier(weight, group.orderBy(*order)),
                "total": F.sum(weight).over(group),
            }
        )

    slices = settle(
        rows.repartitionByRange(*keys)
        .withColumn("slice", F.spark_partition_id())
    )
    totals = slices.groupBy("slice", *groups).agg(F.sum(weight).alias("slice_weight"))
    group = Window.partitionBy(*(groups or [F.lit(0)]))
    starts = totals.select(
        "slice",
        *groups,
        _earlier("slice_weight", group.orderBy("slice")).alias("slice_before"),
        F.sum("slice_weight").over(group).alias("total"),
    )
    inside = Window.partitionBy("slice", *groups).orderBy(*order)
    starts = broadcast_if_small(starts) if groups and not few_groups else F.broadcast(starts)
    joined = _join_null_safe(slices, starts, ["slice", *groups])
    return joined.withColumn(
        "before", F.col("slice_before") + _earlier(weight, inside)
    ).drop("slice", "slice_before")


def _earlier(weight: str, window):
    preceding = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(preceding), F.lit(0)).cast("bigint")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return left.join(renamed, condition).drop(*[f"_{k}" for k in keys])
