"""Exact quantiles, CDFs and the values read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgauge.operators.running import ONE_TASK_ROWS, running_totals
from airgauge.session import settle

CDF_STEPS = 400
BUILT_IN_ROWS = 50_000


def histogram(
    rows: DataFrame,
    value: str = "metric_value",
    groups: Sequence[str] = (),
    more: Sequence[Column] = (),
) -> DataFrame:
    """Equal values of each group counted, written down: groups, ``value``, ``n``, ``start``, ``end``.

    One scan from which summary, percentiles and CDF are all read. ``more`` are sums over
    the rows of a value. Rows without a value are left out.
    """
    present = rows.where(F.col(value).isNotNull())
    return settle(
        present.groupBy(*groups, value).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("measured_at").alias("start"),
            F.max("measured_at").alias("end"),
            *more,
        )
    )


def histogram_summary(
    counts: DataFrame,
    value: str = "metric_value",
    groups: Sequence[str] = (),
    sums: Sequence[str] = (),
) -> DataFrame:
    """Count, extremes, time span and ``sums`` of each group of a histogram."""
    return counts.groupBy(*groups).agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("count"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        *[F.sum(c).alias(c) for c in sums],
    )


def quantiles(
    rows: DataFrame,
    value: str = "metric_value",
    groups: Sequence[str] = (),
    steps: int = CDF_STEPS,
    row_bound: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Interpolated quantiles at 0, 1/steps, .., 1 for each group.

    Result: groups, ``position`` (0..steps), ``probability``, ``value``. Groups
    without values have no rows.

    ``row_bound`` is a number of rows that ``rows`` is known not to exceed. When not given,
    equal values are counted and written down first, which scans ``rows`` once, and the
    counts are what is counted. Few rows go through the built-in ``percentile``, whose
    work for one group is values times quantiles in one task. More go through
    counts of equal values and running totals, and many through totals over a
    range-partitioned order.
    """
    present = rows.where(F.col(value).isNotNull())
    if row_bound is None:
        copies = F.sum(weight) if weight else F.count(F.lit(1))
        present = settle(present.groupBy(*groups, value).agg(copies.alias("n")))
        weight, row_bound = "n", present.count()
    if row_bound <= BUILT_IN_ROWS:
        return built_in_quantiles(present, value, groups, steps, weight)
    sliced = row_bound > ONE_TASK_ROWS
    return ranked_quantiles(present, value, groups, steps, sliced=sliced, weight=weight)


def summary_with_marks(
    rows: DataFrame,
    value: str = "metric_value",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Summary and exact P5, median and P95 of each group, from one scan."""
    counts = histogram(rows, value, groups)
    marks = percentile_columns(
        quantiles(counts, value, groups, steps=20, row_bound=counts.count(), weight="n"), groups
    )
    summary = histogram_summary(counts, value, groups)
    if not groups:
        return summary.crossJoin(F.broadcast(marks))  # one row each
    renamed = marks.withColumnsRenamed({g: f"_{g}" for g in groups})
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    return summary.join(renamed, same).drop(*[f"_{g}" for g in groups])


def built_in_quantiles(
    rows: DataFrame,
    value: str,
    groups: Sequence[str],
    steps: int,
    weight: str | None = None,
) -> DataFrame:
    probabilities = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    frequency = F.col(weight) if weight else F.lit(1)
    values = rows.groupBy(*groups).agg(
        F.percentile(value, probabilities, frequency).alias("values")
    )
    points = values.select(*groups, F.posexplode("values").alias("position", "value"))
    return points.select(
        *groups, "position", _probability(steps).alias("probability"), "value"
    )


def ranked_quantiles(
    rows: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    steps: int = CDF_STEPS,
    sliced: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Quantiles by rank, with no task or group that must hold all values.

    Equal values are counted first, before any row is sent to another task. A
    value with ``before`` smaller ones and ``n`` copies owns ranks
    before..before+n-1. Quantile i falls at rank i*(total-1)/steps, between two
    whole ranks; each value reports the quantiles whose lower or upper rank it
    owns, which takes a few integer divisions for each value.
    """
    copies = F.sum(weight) if weight else F.count(F.lit(1))
    counts = rows.groupBy(*groups, F.col(value).alias("v")).agg(copies.alias("n"))
    ranked = running_totals(counts, ["v"], "n", groups, sliced=sliced).withColumn(
        "last", F.expr("greatest(total - 1, 1)")
    )

    # Lower rank of i is floor(i*last/steps), upper rank is its ceiling. A first
    # filter on whole numbers leaves the few values that own a wanted rank.
    bounds = ranked.selectExpr(
        *groups,
        "v",
        "total",
        f"(before * {steps}L + last - 1) div last AS low_from",
        f"if(total = 1, {steps}L, ((before + n) * {steps}L + last - 1) div last - 1) AS low_to",
        f"if(before = 0, 0L, ((before - 1) * {steps}L) div last + 1) AS high_from",
        f"if(total = 1, {steps}L, ((before + n - 1) * {steps}L) div last) AS high_to",
    ).where("low_from <= low_to OR high_from <= high_to")

    def owned(side: str, low: bool) -> str:
        places = f"sequence({side}_from, least({side}_to, {steps}L))"
        tagged = f"transform({places}, i -> named_struct('i', i, 'low', {str(low).lower()}))"
        return f"if({side}_from <= least({side}_to, {steps}L), {tagged}, array())"

    sides = bounds.selectExpr(
        *groups,
        "v",
        "total",
        f"explode(concat({owned('low', True)}, {owned('high', False)})) AS t",
    )
    ends = sides.groupBy(*groups, F.col("t.i").alias("position")).agg(
        F.max("total").alias("total"),
        F.max(F.when(F.col("t.low"), F.col("v"))).alias("low"),
        F.max(F.when(~F.col("t.low"), F.col("v"))).alias("high"),
    )
    share = F.pmod(F.col("position") * (F.col("total") - 1), F.lit(steps)) / F.lit(steps)
    # Weights of both ends, so that an infinite end does not turn the other into NaN.
    between = F.col("low") * (1 - share) + F.col("high") * share
    return ends.select(
        *groups,
        F.col("position").cast("int").alias("position"),
        _probability(steps).alias("probability"),
        F.when((F.col("low") == F.col("high")) | (share == 0), F.col("low")).otherwise(between).alias("value"),
    )


def _probability(steps: int) -> Column:
    return F.col("position") / F.lit(float(steps))


def metric_summary(
    rows: DataFrame,
    value: str = "metric_value",
    groups: Sequence[str] = (),
    more: Sequence[Column] = (),
) -> DataFrame:
    """Count, extremes and time span of the rows that have a value, in one pass."""
    present = rows.where(F.col(value).isNotNull())
    return present.groupBy(*groups).agg(
        F.count(value).alias("count"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.min("measured_at").alias("start"),
        F.max("measured_at").alias("end"),
        *more,
    )


def percentile_columns(points: DataFrame, groups: Sequence[str] = (), steps: int = 20) -> DataFrame:
    """P5, median and P95 read from quantile rows at their own positions."""

    def at(probability: float) -> Column:
        return F.max(F.when(F.col("position") == round(probability * steps), F.col("value")))

    return points.groupBy(*groups).agg(
        at(0.05).alias("p5"), at(0.5).alias("median"), at(0.95).alias("p95")
    )


def read_from_cdf(points: DataFrame, probability: float, groups: Sequence[str] = ()) -> DataFrame:
    """Value at a probability, interpolated between neighbouring CDF points.

    The points of a group number at most steps + 1, so its window is small.
    """
    w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("probability")
    neighbours = points.select(
        *groups,
        "probability",
        "value",
        F.lag("probability").over(w).alias("p0"),
        F.lag("value").over(w).alias("v0"),
    )
    reached = neighbours.where(F.col("probability") >= probability)
    share = (F.lit(probability) - F.col("p0")) / (F.col("probability") - F.col("p0"))
    value = F.when(F.col("p0").isNull(), F.col("value")).otherwise(
        F.col("v0") + (F.col("value") - F.col("v0")) * share
    )
    return reached.groupBy(*groups).agg(
        F.min_by(value, "probability").alias("value")
    )


def tens_extent(points: DataFrame, value: str = "value", groups: Sequence[str] = ()) -> DataFrame:
    """Chart range: extremes rounded out to tens, at least ten wide."""
    low = F.floor(F.min(value) / 10) * 10
    high = F.ceil(F.max(value) / 10) * 10
    ends = points.groupBy(*groups).agg(low.alias("minimum"), high.alias("maximum"))
    return ends.withColumn(
        "maximum",
        F.when(F.col("minimum") == F.col("maximum"), F.col("minimum") + 10).otherwise(
            F.col("maximum")
        ),
    )
