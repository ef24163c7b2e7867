"""Many compared curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.operators import compare
from airgauge.plans import measurements as requests
from airgauge.plans import payloads
from airgauge.session import settle
from workloads.fixtures import partitions, view
from workloads.registry import query, rounded
from workloads.summaries import read_back

REQUEST = {
    "database": "db_a",
    "start": "2024-01-02 00:00:00",
    "end": "2024-01-28 12:00:00",
    "curves": [
        {"id": "a", "measurement": "radio", "metric": "rsrp_dbm", "collections": ["col_0", "col_1"]},
        {"id": "b", "measurement": "radio", "metric": "rsrp_dbm", "collections": ["col_1", "col_2", "col_1"],
         "technology": "NR", "operator": "op_1", "label": "Second"},
        {"id": "c", "measurement": "pdsch", "metric": "throughput_mbps", "collections": ["col_3"],
         "band": "LTE:3", "color": "#123456", "style": "dotted"},
        {"id": "d", "measurement": "neighbor", "metric": "sinr_db", "collection": "col_4",
         "ssb": "__null__", "operator": "all"},
        {"measurement": "pusch", "metric": "throughput_mbps", "collections": ["col_0", "col_4"], "pci": "10"},
        {"id": "f", "measurement": "radio", "metric": "rsrp_dbm", "collections": ["col_0"], "pci": "77777"},
        {"id": "g", "measurement": "radio", "metric": "rsrp_dbm", "collections": ["nowhere"]},
        {"id": "h", "measurement": "radio", "metric": "sinr_db", "band": "NR:5",
         "collections": ["col_0", "col_1", "col_2", "col_3", "col_4"]},
    ],
}

RANGE_SQL = "database_name = 'db_a' AND measured_at >= TIMESTAMP '2024-01-02' AND measured_at <= TIMESTAMP '2024-01-28 12:00:00'"

# position, metric, WHERE of each curve
CURVES_SQL = [
    (0, "rsrp_dbm", "category = 'radio' AND collection_name IN ('col_0', 'col_1')"),
    (1, "rsrp_dbm", "category = 'radio' AND collection_name IN ('col_1', 'col_2') AND technology = 'NR' AND operator_name = 'op_1'"),
    (2, "throughput_mbps", "category = 'pdsch' AND collection_name = 'col_3' AND technology = 'LTE' AND band_number = 3"),
    (3, "sinr_db", "category = 'neighbor' AND collection_name = 'col_4' AND ssb_index IS NULL"),
    (4, "throughput_mbps", "category = 'pusch' AND collection_name IN ('col_0', 'col_4') AND pci = 10"),
    (5, "rsrp_dbm", "category = 'radio' AND collection_name = 'col_0' AND pci = 77777"),
    (6, "rsrp_dbm", "category = 'radio' AND collection_name = 'nowhere'"),
    (7, "sinr_db", "category = 'radio' AND technology = 'NR' AND band_number = 5"),
]

LABELS = [
    "col_0, col_1",
    "Second",
    "col_3 | b3",
    "col_4 | SSB NaN",
    "col_0, col_4 | PCI 10",
    "col_0 | PCI 77777",
    "nowhere",
    "col_0, col_1, col_2, col_3, col_4 | n5",
]


def per_curve(select: str) -> str:
    return " UNION ALL ".join(
        "SELECT " + select.format(i=i, v=v) + f" FROM m WHERE {RANGE_SQL} AND {where} AND {v} IS NOT NULL"
        for i, v, where in CURVES_SQL
    )


PROBABILITIES = ", ".join(f"{i / 400:.6f}" for i in range(401))
COMPARE_SQL = f"""SELECT CAST(curve AS INTEGER) AS curve, CAST(i AS INTEGER) AS point,
  round(i / 400.0::DOUBLE, 6) AS probability, round(q[i + 1], 6) AS value
  FROM ({per_curve(f"{{i}} AS curve, quantile_cont({{v}}, [{PROBABILITIES}]) AS q")}), range(0, 401) AS t(i)
  WHERE q IS NOT NULL"""


def matches(spark, folder):
    curves = compare.curves_of(REQUEST)
    return curves, compare.match_curves(view(spark, folder, "m"), curves)


@query("compare_cdf", COMPARE_SQL)
def compare_cdf(spark, folder):
    _, cdfs = requests.compare_cdfs(view(spark, folder, "m"), REQUEST)
    return rounded(cdfs, "probability", "value")


@query("compare_cdf_ranked", COMPARE_SQL)
def compare_cdf_ranked(spark, folder):
    """The form for large data, all curves in one range-partitioned order."""
    _, counts = matches(spark, folder)
    cdfs = compare.curve_cdfs(counts, row_bound=2**62)
    return rounded(cdfs, "probability", "value")


@query(
    "compare_curve_counts",
    per_curve("{i} AS position, count({v}) AS n, round(min({v}), 6) AS minimum, round(max({v}), 6) AS maximum").replace(
        "SELECT 0 AS position", "SELECT * FROM (SELECT 0 AS position", 1
    )
    + ") WHERE n > 0",
)
def compare_curve_counts(spark, folder):
    _, counts = matches(spark, folder)
    result = counts.groupBy("position").agg(
        F.sum("n").alias("n"),
        F.min("metric_value").alias("minimum"),
        F.max("metric_value").alias("maximum"),
    )
    return rounded(result, "minimum", "maximum")


SUMMARY_SQL = per_curve(
    "{i} AS position, count({v}) AS count, round(min({v}), 6) AS minimum, round(quantile_cont({v}, 0.05), 6) AS p5, "
    "round(median({v}), 6) AS median, round(quantile_cont({v}, 0.95), 6) AS p95, round(max({v}), 6) AS maximum"
)


@query(
    "compare_empty",
    f"""SELECT s.*, CASE WHEN s.count > 0 THEN NULL WHEN s.position = 6 THEN 'No matching partition'
  ELSE 'No matching rows' END AS note FROM ({SUMMARY_SQL}) s""",
)
def compare_empty(spark, folder):
    summaries, _ = requests.compare_cdfs(
        view(spark, folder, "m"), REQUEST, partitions(spark, folder)
    )
    columns = ("minimum", "p5", "median", "p95", "maximum")
    return rounded(summaries.select("position", "count", "note", *columns), *columns)


def shown_sql(name: str) -> str:
    """A number as a curve's text shows it: two digits at most, grouped, with the unit."""
    exact = f"CAST(round(CAST(round({name}, 6) AS DECIMAL(18, 6)), 2) AS DOUBLE)"
    number = f"regexp_replace(regexp_replace(format('{{:,.2f}}', {exact}), '0+$', ''), '[.]$', '')"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE concat({number}, CASE WHEN unit = '' THEN '' ELSE ' ' END, unit) END"


CURVE_ROWS = ", ".join(
    str((i, label, S.METRICS[c["measurement"]][c["metric"]][1]))
    for i, (label, c) in enumerate(zip(LABELS, REQUEST["curves"]))
)


@query(
    "curve_labels",
    f"""SELECT s.position, l.label, CASE WHEN s.count = 0 THEN 'No samples' ELSE
  concat(format('{{:,}}', s.count), ' samples | Median ', {shown_sql("median")}, ' (P5 ', {shown_sql("p5")},
    ' | P95 ', {shown_sql("p95")}, ')') END AS text FROM ({SUMMARY_SQL}) s
  JOIN (VALUES {CURVE_ROWS}) AS l(position, label, unit) USING (position)""",
)
def curve_labels(spark, folder):
    summaries, _ = requests.compare_cdfs(view(spark, folder, "m"), REQUEST)
    return summaries.select("position", "label", compare.curve_text(summaries).alias("text"))


@query(
    "compare_charts",
    f"""SELECT min(position) AS "first", title, string_agg(concat(id, ':', count), ',' ORDER BY position) AS curves
  FROM ({SUMMARY_SQL}) JOIN (VALUES {", ".join(
      str((i, c.get("id", "curve"),
           f"{S.CATEGORY_LABELS[c['measurement']]}: {S.METRICS[c['measurement']][c['metric']][0]}"))
      for i, c in enumerate(REQUEST["curves"]))}) AS t(position, id, title) USING (position) GROUP BY title""",
)
def compare_charts(spark, folder):
    summaries, _ = requests.compare_cdfs(view(spark, folder, "m"), REQUEST)
    parts = F.transform(
        "curves", lambda c: F.concat_ws(":", c["id"], c["count"].cast("string"))
    )
    return compare.charts(summaries, "count").select(
        "first", "title", F.array_join(parts, ",").alias("curves")
    )


@query(
    "json_compare",
    f"""SELECT s.position, l.label, count, round(median, 6) AS median, title, CASE WHEN count > 0 THEN 401 ELSE 0 END AS points,
    CASE WHEN count > 0 THEN NULL WHEN s.position = 6 THEN 'No matching partition' ELSE 'No matching rows' END AS note
  FROM ({SUMMARY_SQL}) s JOIN (VALUES {", ".join(
      str((i, label, f"{S.CATEGORY_LABELS[c['measurement']]}: {S.METRICS[c['measurement']][c['metric']][0]}"))
      for i, (label, c) in enumerate(zip(LABELS, REQUEST["curves"])))}) AS l(position, label, title) USING (position)""",
)
def json_compare(spark, folder):
    """All curves of a request as one JSON record, read back chart by chart."""
    record = read_back(payloads.compare_payload(view(spark, folder, "m"), REQUEST, partitions(spark, folder)))
    chart = record.select(F.explode("charts").alias("c"))
    curves = chart.select("c.title", F.explode("c.curves").alias("v"))
    return curves.select(
        "v.position", "v.label", "v.count", F.round("v.median", 6).alias("median"), "title",
        F.size("v.points").alias("points"), "v.note",
    )


@query(
    "scope_prune",
    """SELECT position, kept, kept <> collections AS changed FROM (SELECT position, collections,
  array_to_string(list_filter(string_split(collections, ','), lambda c: list_contains(scope, c)), ',') AS kept
  FROM (SELECT list(DISTINCT collection_name) AS scope FROM m),
  (VALUES (0, 'col_0,col_1'), (1, 'col_1,col_2'), (2, 'col_3'), (3, 'col_4'), (4, 'col_0,col_4'), (5, 'col_0'),
    (6, 'nowhere'), (7, 'col_0,col_1,col_2,col_3,col_4')) AS t(position, collections))""",
)
def scope_prune(spark, folder):
    scope = view(spark, folder, "m").agg(F.collect_set("collection_name").alias("scope"))
    curves = compare.curve_table(spark, compare.curves_of(REQUEST)).crossJoin(F.broadcast(scope))
    return compare.prune_collections(curves, F.col("scope")).select(
        "position", F.array_join("kept", ",").alias("kept"), "changed"
    )


BIG_REQUEST_SQL = [
    (0, "database_name = 'db_a'"),
    (1, "database_name = 'db_a' AND technology = 'NR'"),
    (2, "database_name = 'db_a' AND technology = 'LTE' AND operator_name = 'op_1'"),
    (3, "database_name = 'db_a' AND operator_name = 'op_2' AND band_number = 3"),
]


@query(
    "compare_all_rows",
    f"""SELECT CAST(curve AS INTEGER) AS curve, CAST(i AS INTEGER) AS point,
  round(i / 400.0::DOUBLE, 6) AS probability, round(q[i + 1], 6) AS value FROM ("""
    + " UNION ALL ".join(
        f"SELECT {i} AS curve, quantile_cont(metric, [{PROBABILITIES}]) AS q FROM mbig WHERE {where}"
        for i, where in BIG_REQUEST_SQL
    )
    + "), range(0, 401) AS t(i)",
    views=("mbig",),
)
def compare_all_rows(spark, folder):
    rows = view(spark, folder, "mbig").select(
        "database_name",
        "collection_name",
        "technology",
        "operator_name",
        "band_number",
        "pci",
        "measured_at",
        F.lit(None).cast("bigint").alias("ssb_index"),
        F.when(F.col("technology") == "NR", "nr_radio").otherwise("lte_radio").alias("measurement_type"),
        F.col("metric").alias("rsrp_dbm"),
    )
    everywhere = [f"col_{i}" for i in range(7)]
    base = {"measurement": "radio", "metric": "rsrp_dbm", "collections": everywhere}
    request = {
        "database": "db_a",
        "curves": [
            base,
            {**base, "technology": "NR"},
            {**base, "technology": "LTE", "operator": "op_1"},
            {**base, "operator": "op_2", "band": "3"},
        ],
    }
    curves = compare.curves_of(request)
    cdfs = compare.curve_cdfs(settle(compare.match_curves(rows, curves)))
    return rounded(cdfs, "probability", "value")
