"""The request-level queries: summary, points, series, CDF, choices, compare."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.operators import compare, facets, points, quantiles, series
from airgauge.operators.filters import Selection, checked_metric, cleaned, select_rows, with_metric
from airgauge.session import settle


@dataclass(frozen=True)
class MeasurementResult:
    """Results of one selection. Without matching rows only the summary is filled."""

    metric: str
    label: str
    unit: str
    summary: dict[str, object]
    points: DataFrame | None
    series: DataFrame | None


def selected_metric(measurements: DataFrame, arguments: Mapping[str, object]):
    selection = Selection.of(arguments)
    metric = cleaned(arguments.get("metric"))
    if not metric:
        raise ValueError("a request names a metric")
    checked_metric(selection.category, metric)
    return selection, metric, with_metric(select_rows(measurements, selection), metric)


def summary_row(rows: DataFrame) -> dict[str, object]:
    """Summary of one metric with exact P5, median and P95, as a driver-side row.

    All of it is read from one histogram of the values. ``located`` is the number of rows
    that can be put on a map.
    """
    on_map = F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    counts = quantiles.histogram(rows, more=[on_map.alias("located")])
    summary = quantiles.histogram_summary(counts, sums=["located"])
    values = F.count(F.lit(1)).alias("values")
    seconds = series.seconds_between(F.col("start"), F.col("end")).alias("seconds")
    counted = summary.select("*", seconds).crossJoin(counts.agg(values)).first().asDict()  # one row each
    distinct = counted.pop("values")
    if not counted["count"]:
        return {"count": 0}
    marks = quantiles.percentile_columns(
        quantiles.quantiles(counts, steps=20, row_bound=distinct, weight="n")
    ).first()
    return {**counted, **marks.asDict()}


def measurements(rows: DataFrame, arguments: Mapping[str, object]) -> MeasurementResult:
    """Summary, thinned map points and, for one operator, the time series."""
    selection, metric, filtered = selected_metric(rows, arguments)
    label, unit = S.METRICS[selection.category][metric]
    summary = summary_row(filtered)
    if not summary["count"]:
        return MeasurementResult(metric, label, unit, summary, None, None)
    located = points.point_records(filtered, selection.category)
    thinned = points.thin_by_time(located, total=summary["located"])
    over_time = None
    if selection.operator:
        over_time = series.time_series(
            filtered, series.bucket_width(summary["seconds"])
        ).orderBy("bucket")
    return MeasurementResult(
        metric, label, unit, summary, thinned, over_time
    )


def cdf(rows: DataFrame, arguments: Mapping[str, object]) -> DataFrame:
    """The 401 points of the distribution of one metric."""
    _, _, filtered = selected_metric(rows, arguments)
    return quantiles.quantiles(filtered)


def options(rows: DataFrame, arguments: Mapping[str, object]) -> DataFrame:
    """Choices of all filter levels for a selection."""
    selection = Selection.of(arguments, stale=True)
    return facets.ordered_choices(facets.facet_cascade(rows, selection))


def compare_cdfs(
    rows: DataFrame, request: Mapping[str, object], catalog: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Summaries and CDF points of all curves of a request, from one scan."""
    curves = compare.curves_of(request)
    matches = settle(compare.match_curves(rows, curves))
    cdfs = compare.curve_cdfs(matches)
    summaries = compare.curve_summaries(matches, cdfs, curves)
    if catalog is not None:
        summaries = compare.with_notes(summaries, catalog)
    return summaries, cdfs
