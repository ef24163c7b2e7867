"""Filter choices with row counts, each level restricted by the levels above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.functions import labels as L
from airgauge.functions.casts import quoted
from airgauge.operators.filters import Selection
from airgauge.session import settle

LEVELS = ("technology", "operator", "band", "pci", "ssb")
FACET_COLUMNS = ("technology", "operator_name", "band_number", "pci", "ssb_index")


def facet_counts(measurements: DataFrame, selection: Selection) -> DataFrame:
    """Rows and metric values for each combination of facet values in scope.

    The one pass over the measurements that all levels are read from. Counting is
    combined before the shuffle, so a frequent combination stays one row per task.
    Time bounds do not restrict choices.
    """
    scoped = measurements.where(selection.with_fields(technology=None).scope())
    return scoped.groupBy(*FACET_COLUMNS).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(m).alias(m) for m in S.METRICS[selection.category]],
    )


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()


def counted_values(
    counts: DataFrame, column: str, n: str | None = None, with_null: bool = False
) -> DataFrame:
    """Values with their number of rows; ``n`` sums rows that are counts already."""
    kept = counts if with_null else counts.where(F.col(column).isNotNull())
    size = F.sum(n) if n else F.count(F.lit(1))
    return kept.groupBy(F.col(column).alias("value")).agg(size.alias("n"))


def counted_bands(counts: DataFrame, n: str | None = None) -> DataFrame:
    size = F.sum(n) if n else F.count(F.lit(1))
    bands = (
        counts.where(F.col("band_number").isNotNull())
        .groupBy("technology", "band_number")
        .agg(size.alias("n"))
    )
    return bands.select(
        "technology",
        "band_number",
        "n",
        L.band_choice(F.col("technology"), F.col("band_number")).alias("value"),
        L.counted(L.band_text(F.col("technology"), F.col("band_number")), F.col("n")).alias(
            "label"
        ),
    )


def choice_labels(values: DataFrame) -> DataFrame:
    """Choice value and label of counted values; NULL has its own marker and text."""
    return values.select(
        L.null_choice(F.col("value")).alias("value"),
        L.counted(L.nan_text(F.col("value")), F.col("n")).alias("label"),
        F.col("n"),
    )


def metric_counts(rows: DataFrame, category: str, counted: bool = False) -> DataFrame:
    """Metrics of a category that have values, with label, unit and their number."""
    metrics = list(S.METRICS[category])
    size = F.sum if counted else F.count
    one_row = rows.agg(*[F.coalesce(size(m), F.lit(0)).alias(m) for m in metrics])
    long = one_row.unpivot([], metrics, "value", "n")
    return attach_metric_labels(long.where(F.col("n") > 0), F.lit(category))


def metric_dimension(spark) -> DataFrame:
    """The fixed list of category/metric pairs."""
    return spark.createDataFrame(
        [
            (category, S.CATEGORY_LABELS[category], metric, label, unit)
            for category, metric, label, unit in S.METRIC_ROWS
        ],
        "category string, category_label string, metric string, label string, unit string",
    )


def attach_metric_labels(rows: DataFrame, category: Column, metric: str = "value") -> DataFrame:
    known = metric_dimension(rows.sparkSession).select("category", "metric", "label", "unit")
    return (
        rows.withColumn("category", category)
        .join(
            F.broadcast(known.withColumnRenamed("metric", metric)),
            ["category", metric],
        )
        .drop("category")
    )


# A facet value as it is listed as a choice.
_CHOICES = {
    "technology": "technology",
    "operator": "operator_name",
    "band": "concat(technology, ':', band_number)",
    "pci": "CAST(pci AS STRING)",
    "ssb": f"coalesce(CAST(ssb_index AS STRING), '{S.NULL_CHOICE}')",
}

# The text a choice is shown with, before its count.
_TEXTS = {
    **_CHOICES,
    "band": "concat(if(technology = 'LTE', 'b', 'n'), band_number)",
    "ssb": "coalesce(CAST(ssb_index AS STRING), 'NaN')",
}


def level_tests(selection: Selection) -> dict[str, str]:
    """The condition of every chosen level."""
    chosen = {
        "technology": selection.technology,
        "operator": selection.operator,
        "band": selection.band,
        "pci": selection.pci,
        "ssb": selection.ssb,
    }
    return {
        level: f"coalesce({_CHOICES[level]} = {quoted(value)}, false)"
        for level, value in chosen.items()
        if value
    }


def current_choices(counts: DataFrame, selection: Selection) -> dict[str, str]:
    """Conditions of the chosen levels whose value exists under the levels above.

    Groups the combinations by which tests they pass: at most 2**5 rows reach
    the driver.
    """
    tests = level_tests(selection)
    passed = counts.selectExpr(*[f"{test} AS {level}" for level, test in tests.items()])
    patterns = [row.asDict() for row in passed.distinct().collect()]
    valid: dict[str, str] = {}
    for level in tests:
        if any(p[level] and all(p[above] for above in valid) for p in patterns):
            valid[level] = tests[level]
    return valid


def facet_cascade(measurements: DataFrame, selection: Selection) -> DataFrame:
    """All choices of all levels in one table: level, value, label, n.

    Each combination of facet values is tagged with the levels it counts for, so
    the levels share one aggregation. Choices that no longer exist are looked up
    first, in counts that are written down so that the scan is not repeated.
    """
    counts = facet_counts(measurements, selection)
    if not level_tests(selection):
        return cascade_of(counts, selection.category, {})
    counts = settle(counts)
    return cascade_of(counts, selection.category, current_choices(counts, selection))


def cascade_of(counts: DataFrame, category: str, valid: dict[str, str]) -> DataFrame:
    def tag(level: str, shown: str, value: str, text: str, n: str) -> str:
        above = LEVELS[: LEVELS.index(level)] if level in LEVELS else LEVELS
        passing = [valid[upper] for upper in above if upper in valid]
        condition = " AND ".join([shown, *passing])
        fields = f"'level', '{level}', 'value', {value}, 'text', {text}, 'n', {n}"
        return f"if({condition}, named_struct({fields}), NULL)"

    tags = [
        tag(level, f"{_CHOICES[level]} IS NOT NULL", _CHOICES[level], _TEXTS[level], "n")
        for level in LEVELS
    ]
    tags += [
        tag("metric", f"{m} > 0", quoted(m), quoted(label), m)
        for m, (label, _) in S.METRICS[category].items()
    ]
    tagged = counts.selectExpr(
        f"explode(filter(array({', '.join(tags)}), t -> t IS NOT NULL)) AS t"
    ).select("t.*")
    summed = tagged.groupBy("level", "value", "text").agg(F.sum("n").alias("n"))
    return summed.selectExpr(
        "level",
        "value",
        "if(level IN ('band', 'pci', 'ssb'), concat(text, ' (#', format_number(n, 0), ')'), text)"
        " AS label",
        "n",
    )


def choice_number() -> Column:
    """Number in a choice, such as the band in ``LTE:48``."""
    return F.regexp_extract("value", r"^(?:\w+:)?(\d+)$", 1).try_cast("bigint")


def ordered_choices(choices: DataFrame) -> DataFrame:
    """Choices level by level; numbers by size, the choice for NULL last."""
    return choices.orderBy(
        F.array_position(F.array(*[F.lit(x) for x in (*LEVELS, "metric")]), F.col("level")),
        F.col("value") == S.NULL_CHOICE,
        F.when(F.col("level") == "band", F.substring_index("value", ":", 1)),
        choice_number().asc_nulls_first(),
        "value",
    )
