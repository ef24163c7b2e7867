"""Request results as nested JSON records, one row each.

Every list in a record is limited by its query: 401 CDF points, 6,000 map points,
the buckets of a series, the choices of a filter level, 20 curves, the catalog.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.operators import catalog, compare, facets, quantiles
from airgauge.operators.catalog import iso
from airgauge.plans import measurements as requests

_KEEP_NULLS = {"ignoreNullFields": "false"}


def as_json(row: DataFrame) -> DataFrame:
    """A result row as JSON text in which NULL fields are kept."""
    return row.select(F.to_json(F.struct(*row.columns), _KEEP_NULLS).alias("payload"))


def _listed(order: tuple[str, ...], fields: Column) -> Column:
    """Records in order; the order itself is not part of them."""
    entries = F.sort_array(F.collect_list(F.struct(*order, fields.alias("_record"))))
    return F.transform(entries, lambda e: e["_record"])


def cdf_payload(rows: DataFrame, arguments: Mapping[str, object]) -> DataFrame:
    selection, metric, filtered = requests.selected_metric(rows, arguments)
    label, unit = S.METRICS[selection.category][metric]
    values = quantiles.histogram(filtered)
    seen = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("values")).first()
    count = seen.rows
    points = quantiles.quantiles(values, row_bound=seen["values"], weight="n").agg(
        _listed(("position",), F.struct("value", "probability")).alias("points")
    )
    return points.select(
        F.lit(metric).alias("metric"),
        F.lit(label).alias("label"),
        F.lit(unit).alias("unit"),
        F.lit(count).cast("bigint").alias("count"),
        "points",
    )


def options_payload(rows: DataFrame, arguments: Mapping[str, object]) -> DataFrame:
    choices = requests.options(rows, arguments)
    category = str(arguments.get("measurement") or "radio")
    units = F.create_map(*[F.lit(x) for m, (_, u) in S.METRICS[category].items() for x in (m, u)])
    metrics = F.array(*[F.lit(m) for m in S.METRICS[category]])
    placed = choices.withColumns(
        {
            "last": F.col("value") == S.NULL_CHOICE,
            "head": F.when(F.col("level") == "band", F.substring_index("value", ":", 1)),
            "number": F.when(
                F.col("level") == "metric", F.array_position(metrics, F.col("value"))
            ).otherwise(facets.choice_number()),
        }
    )

    def level(name: str, record: Column) -> Column:
        entry = F.when(F.col("level") == name, F.struct("last", "head", "number", "value", record.alias("r")))
        kept = F.sort_array(F.filter(F.collect_list(entry), lambda e: e.isNotNull()))
        return F.transform(kept, lambda e: e["r"])

    choice = F.struct("value", "label")
    metric = F.struct("value", "label", units[F.col("value")].alias("unit"))
    return placed.agg(
        level("technology", F.col("value")).alias("technologies"),
        level("operator", F.col("value")).alias("operators"),
        level("band", choice).alias("bands"),
        level("pci", F.struct(F.col("value").try_cast("bigint").alias("value"), "label")).alias("pcis"),
        level("ssb", choice).alias("ssb_indexes"),
        level("metric", metric).alias("metrics"),
    )


def measurement_payload(rows: DataFrame, arguments: Mapping[str, object]) -> DataFrame:
    result = requests.measurements(rows, arguments)
    head = {"metric": result.metric, "label": result.label, "unit": result.unit}
    summary = dict(result.summary)
    start, end = summary.pop("start", None), summary.pop("end", None)
    names = [n for n in summary if n not in ("located", "seconds")]
    values = [F.lit(summary[n]).alias(n) for n in names]
    if start is not None:
        values += [
            iso(F.lit(t).cast("timestamp_ntz")).alias(n) for n, t in (("start", start), ("end", end))
        ]
    empty = F.array().alias("e")
    record = rows.sparkSession.range(1).select(
        *[F.lit(v).alias(k) for k, v in head.items()],
        F.struct(*values).alias("summary"),
    )
    if result.points is None:
        return record.withColumns({"points": empty, "series": empty})

    columns = [c for c in result.points.columns if c != "measured_at"]
    point = F.struct(columns[0], iso(F.col("measured_at")).alias("measured_at"), *columns[1:])
    points = result.points.agg(_listed(("measured_at",), point).alias("points"))
    record = record.crossJoin(F.broadcast(points))
    if result.series is None:
        return record.withColumn("series", empty)
    bucket = F.struct(
        iso(F.col("bucket")).alias("time"), "average", "minimum", "maximum", "samples"
    )
    return record.crossJoin(
        F.broadcast(result.series.agg(_listed(("bucket",), bucket).alias("series")))
    )


def compare_payload(
    rows: DataFrame, request: Mapping[str, object], partitions: DataFrame | None = None
) -> DataFrame:
    summaries, cdfs = requests.compare_cdfs(rows, request, partitions)
    points = cdfs.groupBy(F.col("curve").alias("position")).agg(
        _listed(("point",), F.struct("value", "probability")).alias("points")
    )
    if "note" not in summaries.columns:
        summaries = summaries.withColumn("note", F.lit(None).cast("string"))
    full = summaries.join(points, "position", "left").withColumn(
        "points", F.coalesce("points", F.expr("CAST(array() AS ARRAY<STRUCT<value: DOUBLE, probability: DOUBLE>>)"))
    )
    chart = compare.charts(
        full, "color", "style", "collections", "count", "minimum", "maximum",
        "p5", "median", "p95", "points", "note",
    )
    fields = F.struct(
        "measurement", "measurement_label", "metric", "metric_label", "unit", "title", "curves"
    )
    return chart.agg(_listed(("first",), fields).alias("charts")).select(
        F.lit(request["database"]).alias("database"),
        F.lit(request.get("start")).cast("string").alias("start"),
        F.lit(request.get("end")).cast("string").alias("end"),
        F.lit(len(request["curves"])).alias("curve_count"),
        "charts",
    )


def catalog_payload(partitions: DataFrame) -> DataFrame:
    """Databases with their collections, and the metrics of each measurement."""
    entries = catalog.collection_entries(partitions)
    collection = F.struct(
        F.col("collection_name").alias("name"),
        iso(F.col("start")).alias("start"),
        iso(F.col("end")).alias("end"),
        "categories",
        "technologies",
    )
    databases = entries.groupBy("database_name").agg(
        _listed(("collection_name",), collection).alias("collections")
    )
    database = F.struct(F.col("database_name").alias("name"), "collections")
    measurements = F.array(
        *[
            F.struct(
                F.lit(category).alias("value"),
                F.array(
                    *[
                        F.struct(F.lit(m).alias("value"), F.lit(x).alias("label"), F.lit(u).alias("unit"))
                        for m, (x, u) in metrics.items()
                    ]
                ).alias("metrics"),
            )
            for category, metrics in S.METRICS.items()
        ]
    )
    return databases.agg(
        _listed(("database_name",), database).alias("databases")
    ).withColumn("measurements", measurements)
