"""Filter choices and their counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.operators import facets
from airgauge.operators.filters import Selection, checked, checked_technology, select_rows
from airgauge.plans import payloads
from airgauge.sources.store import union_kinds
from workloads.fixtures import view
from workloads.registry import query
from workloads.summaries import COLLECTIONS, RADIO_SQL, read_back


def scoped(spark, folder, **arguments):
    selection = Selection.of({"database": "db_a", "collections": COLLECTIONS, **arguments})
    return select_rows(view(spark, folder, "m"), selection)


@query("facet_technologies", "SELECT DISTINCT technology AS value FROM m WHERE technology IS NOT NULL")
def facet_technologies(spark, folder):
    return facets.distinct_values(view(spark, folder, "m"), "technology")


@query("facet_operators", f"SELECT DISTINCT operator_name AS value FROM m WHERE {RADIO_SQL} AND technology = 'NR'")
def facet_operators(spark, folder):
    return facets.distinct_values(scoped(spark, folder, technology="NR"), "operator_name")


BAND_TEXT = "concat(CASE WHEN technology = 'LTE' THEN 'b' ELSE 'n' END, band_number, ' (#', format('{:,}', count(*)), ')')"


@query(
    "facet_bands",
    f"""SELECT technology, band_number, count(*) AS n, concat(technology, ':', band_number) AS value,
  {BAND_TEXT} AS label FROM m WHERE band_number IS NOT NULL GROUP BY technology, band_number""",
)
def facet_bands(spark, folder):
    return facets.counted_bands(view(spark, folder, "m"))


def choices_sql(column: str, where: str) -> str:
    return f"""SELECT coalesce(CAST({column} AS VARCHAR), '__null__') AS value,
  concat(coalesce(CAST({column} AS VARCHAR), 'NaN'), ' (#', format('{{:,}}', count(*)), ')') AS label,
  count(*) AS n FROM m WHERE {where} GROUP BY {column}"""


@query("facet_pcis", choices_sql("pci", "pci IS NOT NULL"))
def facet_pcis(spark, folder):
    return facets.choice_labels(facets.counted_values(view(spark, folder, "m"), "pci"))


@query("facet_ssb", choices_sql("ssb_index", "TRUE"))
def facet_ssb(spark, folder):
    rows = view(spark, folder, "m")
    return facets.choice_labels(facets.counted_values(rows, "ssb_index", with_null=True))


def metrics_sql(category: str, where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS value, '{label}' AS label, '{unit}' AS unit, count({m}) AS n FROM m "
        f"WHERE {where} HAVING count({m}) > 0"
        for m, (label, unit) in S.METRICS[category].items()
    )


@query(
    "facet_metrics",
    metrics_sql("neighbor", "measurement_type = 'lte_radio_neighbor'"),
)
def facet_metrics(spark, folder):
    rows = view(spark, folder, "m").where(F.col("measurement_type") == "lte_radio_neighbor")
    return facets.metric_counts(rows, "neighbor")


@query(
    "metric_catalog",
    "SELECT * FROM (VALUES "
    + ", ".join(
        str((c, S.CATEGORY_LABELS[c], m, label, unit)) for c, m, label, unit in S.METRIC_ROWS
    )
    + ") AS t(category, category_label, metric, label, unit)"
    " JOIN (SELECT category, count(*) AS n FROM m GROUP BY category) USING (category)",
)
def metric_catalog(spark, folder):
    """Every metric with its labels and the rows of its category."""
    sizes = view(spark, folder, "m").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(F.broadcast(facets.metric_dimension(spark)), "category")


CASCADE = {
    "database": "db_a",
    "collections": COLLECTIONS,
    "measurement": "radio",
    "technology": "NR",
    "operator": "op_1",
    "band": "NR:3",
    "pci": "99999",
    "ssb": "__null__",
}

# PCI 99999 is not offered, so it restricts nothing below.
_TECH = f"{RADIO_SQL} AND technology = 'NR'"
_OPER = f"{_TECH} AND operator_name = 'op_1'"
_BAND = f"{_OPER} AND band_number = 3"
_SSB = f"{_BAND} AND ssb_index IS NULL"

CASCADE_SQL = f"""
SELECT 'technology' AS level, technology AS value, technology AS label, count(*) AS n
  FROM m WHERE {RADIO_SQL} GROUP BY technology
UNION ALL SELECT 'operator', operator_name, operator_name, count(*) FROM m WHERE {_TECH} GROUP BY operator_name
UNION ALL SELECT 'band', concat(technology, ':', band_number), {BAND_TEXT}, count(*)
  FROM m WHERE {_OPER} AND band_number IS NOT NULL GROUP BY technology, band_number
UNION ALL SELECT 'pci', value, label, n FROM ({choices_sql('pci', _BAND)})
UNION ALL SELECT 'ssb', value, label, n FROM ({choices_sql('ssb_index', _BAND)})
UNION ALL SELECT 'metric', value, label, n FROM ({metrics_sql('radio', _SSB)})
"""


@query("facet_cascade", CASCADE_SQL)
def facet_cascade(spark, folder):
    return facets.facet_cascade(view(spark, folder, "m"), Selection.of(CASCADE))


@query(
    "facet_cascade_unrestricted",
    CASCADE_SQL.replace(" AND technology = 'NR'", "")
    .replace(" AND operator_name = 'op_1'", "")
    .replace(" AND band_number = 3", "")
    .replace(" AND ssb_index IS NULL", ""),
)
def facet_cascade_unrestricted(spark, folder):
    selection = Selection.of({"database": "db_a", "collections": COLLECTIONS})
    return facets.facet_cascade(view(spark, folder, "m"), selection)


CHOSEN = {"database": "db_a", "collections": COLLECTIONS, "measurement": "radio", "technology": "NR", "operator": "op_1"}


@query(
    "json_options",
    f"""SELECT level, value, label, unit FROM (SELECT level, value, label, n, NULL AS unit FROM ({CASCADE_SQL.replace(" AND band_number = 3", "").replace(" AND ssb_index IS NULL", "")}) c
    WHERE level <> 'metric')
  UNION ALL SELECT 'metric', value, label, unit FROM ({metrics_sql("radio", _OPER)})""",
)
def json_options(spark, folder):
    """The choices of a whole request as one JSON record, read back level by level."""
    record = read_back(payloads.options_payload(view(spark, folder, "m"), CHOSEN))
    unit = F.lit(None).cast("string").alias("unit")
    levels = []
    for level, field in (("technology", "technologies"), ("operator", "operators")):
        value = F.explode(field).alias("value")
        levels.append(record.select(F.lit(level).alias("level"), value).select("level", "value", F.col("value").alias("label"), unit))
    for level, field in (("band", "bands"), ("pci", "pcis"), ("ssb", "ssb_indexes")):
        listed = record.select(F.lit(level).alias("level"), F.explode(field).alias("c"))
        levels.append(listed.select("level", F.col("c.value").cast("string").alias("value"), "c.label", unit))
    metrics = record.select(F.lit("metric").alias("level"), F.explode("metrics").alias("c"))
    levels.append(metrics.select("level", "c.value", "c.label", "c.unit"))
    return union_kinds(levels)


@query(
    "choice_checks",
    """SELECT value, CASE WHEN upper(value) IN ('LTE', 'NR') THEN upper(value) END AS technology,
  CASE WHEN value IN ('radio', 'neighbor', 'pdsch', 'pusch') THEN value END AS category, n
  FROM (SELECT value, count(*) AS n FROM (SELECT unnest([technology, lower(technology), category, rat, modulation]) AS value FROM m)
    GROUP BY value)""",
)
def choice_checks(spark, folder):
    """Texts of the rows as arguments: taken, or refused as no technology and no category."""
    texts = F.explode(F.array("technology", F.lower("technology"), "category", "rat", "modulation")).alias("value")
    counts = view(spark, folder, "m").select(texts).groupBy("value").agg(F.count(F.lit(1)).alias("n"))

    def taken(check, value):
        try:
            return check(value)
        except ValueError:
            return None

    rows = [
        (r.value, taken(checked_technology, r.value), taken(lambda v: checked(v, S.CATEGORIES, "category"), r.value), r.n)
        for r in counts.collect()  # a dozen texts
    ]
    return spark.createDataFrame(rows, "value string, technology string, category string, n bigint")
