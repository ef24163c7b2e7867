"""Selections, summaries, CDFs and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgauge.functions import casts
from airgauge.operators import filters, points, quantiles, series
from airgauge.operators.filters import Selection
from airgauge.plans import measurements as requests
from airgauge.plans import payloads
from workloads.fixtures import view
from workloads.registry import query, rounded

COLLECTIONS = ["col_0", "col_1", "col_2", "col_3", "col_4"]
RADIO = {"database": "db_a", "collections": COLLECTIONS, "measurement": "radio", "metric": "rsrp_dbm"}
DOWNLINK = {
    "database": "db_b",
    "collections": ["col_1", "col_2", "col_3", "col_4"],
    "measurement": "pdsch",
    "metric": "throughput_mbps",
    "technology": "nr",
    "operator": "op_1",
}

RADIO_SQL = """database_name = 'db_a' AND collection_name IN ('col_0', 'col_1', 'col_2', 'col_3', 'col_4')
  AND measurement_type IN ('lte_radio', 'nr_radio')"""
DOWNLINK_SQL = """database_name = 'db_b' AND collection_name IN ('col_1', 'col_2', 'col_3', 'col_4')
  AND measurement_type = 'nr_pdsch' AND technology = 'NR' AND operator_name = 'op_1'"""

def count_by_key(rows):
    return rows.groupBy("database_name", "collection_name", "measurement_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


def by_key(where: str) -> str:
    return (
        "SELECT database_name, collection_name, measurement_type, count(*) AS n, "
        f"CAST(sum(event_id) AS BIGINT) AS ids FROM m WHERE {where} "
        "GROUP BY database_name, collection_name, measurement_type"
    )


def selected(spark, folder, **arguments):
    selection = Selection.of({"database": "db_a", "collections": COLLECTIONS, **arguments})
    return count_by_key(filters.select_rows(view(spark, folder, "m"), selection))


@query("scope_filter", by_key("""database_name = 'db_b' AND collection_name IN ('col_1', 'col_3')
  AND measurement_type IN ('lte_pusch', 'nr_pusch')"""))
def scope_filter(spark, folder):
    selection = Selection.of(
        {"database": "db_b", "collections": ["col_1", "col_3"], "measurement": "pusch"}
    )
    return count_by_key(view(spark, folder, "m").where(selection.scope()))


@query("kind_pruning", by_key("""database_name = 'db_a' AND measurement_type = 'nr_radio_neighbor'"""))
def kind_pruning(spark, folder):
    return selected(spark, folder, measurement="neighbor", technology="NR")


@query("facet_filter", by_key(RADIO_SQL + " AND technology = 'NR' AND operator_name = 'op_2' AND pci = 8 AND ssb_index = 4"))
def facet_filter(spark, folder):
    return selected(spark, folder, technology="NR", operator="op_2", pci="8", ssb="4", band="all")


@query("null_sentinel_filter", by_key(RADIO_SQL + " AND ssb_index IS NULL"))
def null_sentinel_filter(spark, folder):
    return selected(spark, folder, ssb="__null__")


@query("band_filter", by_key(RADIO_SQL + " AND technology = 'LTE' AND band_number = 3")
       + " UNION ALL " + by_key(RADIO_SQL + " AND band_number = 5"))
def band_filter(spark, folder):
    return selected(spark, folder, band="LTE:3").unionAll(selected(spark, folder, band="5"))


@query("time_range", by_key(RADIO_SQL + """ AND measured_at >= TIMESTAMP '2024-01-05 06:00:00'
  AND measured_at <= TIMESTAMP '2024-01-20'"""))
def time_range(spark, folder):
    good = selected(spark, folder, start="2024-01-05T06:00:00", end="2024-01-20 00:00:00")
    return good.unionAll(selected(spark, folder, start="not a time"))


SUMMARY_SQL = """SELECT count({v}) AS count, round(min({v}), 6) AS minimum, round(max({v}), 6) AS maximum,
  round(quantile_cont({v}, 0.05), 6) AS p5, round(median({v}), 6) AS median,
  round(quantile_cont({v}, 0.95), 6) AS p95, min(measured_at) AS start, max(measured_at) AS "end"
  FROM m WHERE {where} AND {v} IS NOT NULL"""


def summarized(rows, groups=()):
    return rounded(quantiles.summary_with_marks(rows, groups=groups), "minimum", "maximum", "p5", "median", "p95")


@query("metric_summary", SUMMARY_SQL.format(v="throughput_mbps", where=DOWNLINK_SQL))
def metric_summary(spark, folder):
    _, _, rows = requests.selected_metric(view(spark, folder, "m"), DOWNLINK)
    return summarized(rows)


@query(
    "metric_summary_by_partition",
    """SELECT database_name, collection_name, measurement_type, count(rsrp_dbm) AS count,
  round(min(rsrp_dbm), 6) AS minimum, round(max(rsrp_dbm), 6) AS maximum,
  round(quantile_cont(rsrp_dbm, 0.05), 6) AS p5, round(median(rsrp_dbm), 6) AS median,
  round(quantile_cont(rsrp_dbm, 0.95), 6) AS p95, min(measured_at) AS start, max(measured_at) AS "end"
  FROM m GROUP BY database_name, collection_name, measurement_type""",
)
def metric_summary_by_partition(spark, folder):
    rows = filters.with_metric(view(spark, folder, "m"), "rsrp_dbm")
    return summarized(rows, ["database_name", "collection_name", "measurement_type"])


def cdf_sql(value: str, source: str, where: str) -> str:
    probabilities = ", ".join(f"{i / 400:.6f}" for i in range(401))
    return f"""SELECT CAST(i AS INTEGER) AS position, round(i / 400.0::DOUBLE, 6) AS probability,
  round(q[i + 1], 6) AS value
  FROM (SELECT quantile_cont({value}, [{probabilities}]) AS q FROM {source} WHERE {where} AND {value} IS NOT NULL),
  range(0, 401) AS t(i)"""


CDF_SQL = cdf_sql("rsrp_dbm", "m", RADIO_SQL)


@query("cdf", CDF_SQL)
def cdf(spark, folder):
    return rounded(requests.cdf(view(spark, folder, "m"), RADIO), "probability", "value")


@query("cdf_ranked", CDF_SQL)
def cdf_ranked(spark, folder):
    """The form for large data, over a range-partitioned order."""
    _, _, rows = requests.selected_metric(view(spark, folder, "m"), RADIO)
    return rounded(quantiles.ranked_quantiles(rows, "metric_value"), "probability", "value")


@query("cdf_all_rows", cdf_sql("metric", "mbig", "TRUE"), views=("mbig",))
def cdf_all_rows(spark, folder):
    rows = filters.with_metric(view(spark, folder, "mbig"), "metric")
    return rounded(quantiles.quantiles(rows), "probability", "value")


@query("cdf_all_rows_ranked", cdf_sql("metric", "mbig", "TRUE"), views=("mbig",))
def cdf_all_rows_ranked(spark, folder):
    rows = filters.with_metric(view(spark, folder, "mbig"), "metric")
    return rounded(quantiles.ranked_quantiles(rows, "metric_value"), "probability", "value")


INFINITE_SQL = """CASE WHEN event_id % 5 = 0 THEN {low} WHEN event_id % 7 = 0 THEN {high} WHEN event_id % 6 = 0 THEN NULL ELSE rsrp_dbm END"""
INFINITE_VIEW = f"SELECT {INFINITE_SQL.format(low="'-inf'::DOUBLE", high="'inf'::DOUBLE")} AS v FROM m"


def infinite_rows(spark, folder):
    value = INFINITE_SQL.format(low="double('-Infinity')", high="double('Infinity')")
    return view(spark, folder, "m").selectExpr(f"{value} AS metric_value")


@query("cdf_infinite", cdf_sql("v", f"({INFINITE_VIEW})", "TRUE"))
def cdf_infinite(spark, folder):
    """Infinite values at both ends, in the built-in form."""
    return rounded(quantiles.quantiles(infinite_rows(spark, folder), row_bound=0), "probability", "value")


@query("cdf_infinite_ranked", cdf_sql("v", f"({INFINITE_VIEW})", "TRUE"))
def cdf_infinite_ranked(spark, folder):
    """The same in the form for large data."""
    return rounded(quantiles.quantiles(infinite_rows(spark, folder), row_bound=2**62), "probability", "value")


@query("json_cdf", CDF_SQL)
def json_cdf(spark, folder):
    """The points as they are read back from a JSON record."""
    record = payloads.as_json(payloads.cdf_payload(view(spark, folder, "m"), RADIO))
    parsed = F.from_json("payload", "points ARRAY<STRUCT<value: DOUBLE, probability: DOUBLE>>")
    listed = record.select(F.posexplode(parsed["points"]).alias("position", "p"))
    return rounded(listed.select("position", "p.probability", "p.value"), "probability", "value")


@query(
    "curve_percentiles",
    f"""SELECT round(quantile_cont(rsrp_dbm, 0.05), 6) AS p5, round(quantile_cont(rsrp_dbm, 0.5), 6) AS median,
  round(quantile_cont(rsrp_dbm, 0.95), 6) AS p95 FROM m WHERE {RADIO_SQL}""",
)
def curve_percentiles(spark, folder):
    points_ = requests.cdf(view(spark, folder, "m"), RADIO)
    return rounded(quantiles.percentile_columns(points_, steps=400), "p5", "median", "p95")


@query(
    "cdf_interpolate",
    f"""WITH pts AS ({CDF_SQL})
  SELECT round(a.value + (b.value - a.value) * 0.4::DOUBLE, 4) AS value
  FROM pts a, pts b WHERE a.position = 133 AND b.position = 134""".replace("WITH pts", ", pts", 1),
)
def cdf_interpolate(spark, folder):
    found = quantiles.read_from_cdf(requests.cdf(view(spark, folder, "m"), RADIO), 133.4 / 400)
    return found.withColumn("value", F.round("value", 4))


@query(
    "chart_extent",
    f"""SELECT lo AS minimum, CASE WHEN lo = hi THEN hi + 10 ELSE hi END AS maximum FROM (
  SELECT CAST(floor(min(rsrp_dbm) / 10) * 10 AS BIGINT) AS lo, CAST(ceil(max(rsrp_dbm) / 10) * 10 AS BIGINT) AS hi
  FROM m WHERE {RADIO_SQL} AND rsrp_dbm IS NOT NULL)""",
)
def chart_extent(spark, folder):
    return quantiles.tens_extent(requests.cdf(view(spark, folder, "m"), RADIO))


WIDTHS = ", ".join(f"({w})" for w in series.BUCKET_WIDTHS)
WIDTH_SQL = f"""coalesce((SELECT min(w) FROM (VALUES {WIDTHS}) AS widths(w)
  WHERE w >= greatest(1, seconds / 500.0)), 86400)"""


@query(
    "nice_bucket",
    f"""SELECT day, CAST(coalesce(min(w), 86400) AS INTEGER) AS width FROM (
  SELECT date_trunc('day', measured_at) AS day, epoch(max(measured_at)) - epoch(min(measured_at)) AS seconds
  FROM m GROUP BY 1) LEFT JOIN (VALUES {WIDTHS}) AS widths(w) ON w >= greatest(1, seconds / 500.0) GROUP BY day""",
)
def nice_bucket(spark, folder):
    days = view(spark, folder, "m").groupBy(F.date_trunc("day", "measured_at").alias("day")).agg(
        series.seconds_between(F.min("measured_at"), F.max("measured_at")).alias("seconds")
    )
    return days.select(
        F.col("day").cast("timestamp_ntz").alias("day"),
        series.bucket_width_of(F.col("seconds")).alias("width"),
    )


SERIES_SQL = f"""SELECT TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(measured_at) / w) * w AS BIGINT)) AS bucket,
  round(avg(throughput_mbps), 6) AS average, round(min(throughput_mbps), 6) AS minimum,
  round(max(throughput_mbps), 6) AS maximum, count(throughput_mbps) AS samples
  FROM m, (SELECT coalesce(min(w), 86400) AS w FROM (SELECT epoch(max(measured_at)) - epoch(min(measured_at)) AS seconds
    FROM m WHERE {DOWNLINK_SQL} AND throughput_mbps IS NOT NULL)
    LEFT JOIN (VALUES {WIDTHS}) AS widths(w) ON w >= greatest(1, seconds / 500.0))
  WHERE {DOWNLINK_SQL} AND throughput_mbps IS NOT NULL GROUP BY 1"""


@query("time_series", SERIES_SQL)
def time_series(spark, folder):
    result = requests.measurements(view(spark, folder, "m"), DOWNLINK)
    return rounded(result.series, "average", "minimum", "maximum")


@query("time_series_extent", f"SELECT min(minimum) AS minimum, max(maximum) AS maximum FROM ({SERIES_SQL})")
def time_series_extent(spark, folder):
    result = requests.measurements(view(spark, folder, "m"), DOWNLINK)
    return rounded(series.series_extent(result.series), "minimum", "maximum")


@query(
    "time_series_all_rows",
    """SELECT date_trunc('day', measured_at) AS bucket, round(avg(metric) * count(*), 2) / count(*) AS average,
  round(min(metric), 4) AS minimum, round(max(metric), 4) AS maximum, count(*) AS samples
  FROM mbig GROUP BY 1""",
    views=("mbig",),
)
def time_series_all_rows(spark, folder):
    rows = filters.with_metric(view(spark, folder, "mbig"), "metric")
    seconds = quantiles.metric_summary(rows).select(
        series.seconds_between(F.col("start"), F.col("end"))
    ).first()[0]
    result = series.time_series(rows, series.bucket_width(seconds))
    # Prices have two digits, so their total is exact to two digits in any order.
    total = F.round(F.col("average") * F.col("samples"), 2)
    return result.withColumns(
        {
            "average": total / F.col("samples"),
            "minimum": F.round("minimum", 4),
            "maximum": F.round("maximum", 4),
        }
    )


@query(
    "scale_ticks",
    f"""SELECT CAST(i AS INTEGER) AS tick, round(lo + (hi - lo) * i / 4.0::DOUBLE, 6) AS value
  FROM (SELECT min(rsrp_dbm) AS lo, max(rsrp_dbm) AS hi FROM m WHERE {RADIO_SQL}), range(0, 5) AS t(i)""",
)
def scale_ticks(spark, folder):
    _, _, rows = requests.selected_metric(view(spark, folder, "m"), RADIO)
    return rounded(points.scale_ticks(quantiles.metric_summary(rows)), "value")


@query(
    "metric_ratio",
    """SELECT event_id, round(greatest(0::DOUBLE, least(1::DOUBLE,
  (rsrp_dbm - lo) / CASE WHEN hi = lo THEN 1::DOUBLE ELSE hi - lo END)), 6) AS ratio
  FROM m, (SELECT min(rsrp_dbm) AS lo, max(rsrp_dbm) AS hi FROM m)""",
)
def metric_ratio(spark, folder):
    rows = filters.with_metric(view(spark, folder, "m"), "rsrp_dbm")
    ends = quantiles.metric_summary(rows).select("minimum", "maximum")
    placed = rows.crossJoin(F.broadcast(ends))  # one row
    ratio = points.scale_position(F.col("metric_value"), F.col("minimum"), F.col("maximum"))
    return placed.select("event_id", F.round(ratio, 6).alias("ratio"))


@query(
    "json_payload",
    """SELECT collection_name, CAST(json_object('collection', collection_name, 'count', count(*),
  'start', strftime(min(measured_at), '%Y-%m-%dT%H:%M:%S.%f'), 'missing', NULL,
  'range', json_object('first', min(event_id), 'last', max(event_id))) AS VARCHAR) AS payload
  FROM m GROUP BY collection_name""",
)
def json_payload(spark, folder):
    from airgauge.operators.catalog import iso

    rows = view(spark, folder, "m").groupBy("collection_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("measured_at").alias("start"),
        F.min("event_id").alias("first"),
        F.max("event_id").alias("last"),
    )
    record = F.struct(
        F.col("collection_name").alias("collection"),
        F.col("n").alias("count"),
        iso(F.col("start")).alias("start"),
        F.lit(None).cast("string").alias("missing"),
        F.struct("first", "last").alias("range"),
    )
    return rows.select(
        "collection_name", F.to_json(record, {"ignoreNullFields": "false"}).alias("payload")
    )


@query(
    "clean_strings",
    """SELECT event_id, nullif(trim(database_text), '') AS database_name,
  nullif(trim(collection_text), '') AS collection_name FROM raw""",
    views=("raw",),
)
def clean_strings(spark, folder):
    return view(spark, folder, "raw").select(
        "event_id",
        F.expr(casts.clean_text("database_text")).alias("database_name"),
        F.expr(casts.clean_text("collection_text")).alias("collection_name"),
    )


@query(
    "safe_casts",
    """SELECT event_id, try_cast(pci_text AS BIGINT) AS pci, try_cast(throughput_kbps_text AS DOUBLE) AS throughput,
  try_cast(beam_text AS BOOLEAN) AS beam, try_cast(time_text AS TIMESTAMP) AS measured_at FROM raw""",
    views=("raw",),
)
def safe_casts(spark, folder):
    return view(spark, folder, "raw").select(
        "event_id",
        F.expr(casts.bigint("pci_text")).alias("pci"),
        F.expr(casts.double("throughput_kbps_text")).alias("throughput"),
        F.expr(casts.flag("beam_text")).alias("beam"),
        F.expr(casts.time("time_text")).alias("measured_at"),
    )


@query(
    "unit_convert",
    "SELECT event_id, try_cast(throughput_kbps_text AS DOUBLE) / 1000 AS throughput_mbps FROM raw",
    views=("raw",),
)
def unit_convert(spark, folder):
    from airgauge import schema as S

    column = next(c for c in S.COLUMNS["pdsch"] if c.name == "throughput_mbps")
    return view(spark, folder, "raw").select(
        "event_id",
        F.expr(casts.canonical_value("throughput_kbps_text", column)).alias("throughput_mbps"),
    )


def read_back(record):
    """A record written as JSON text and read again by its schema."""
    text = payloads.as_json(record)
    return text.select(F.from_json("payload", record.schema).alias("r")).select("r.*")


def timed(column):
    return F.col(column).cast("timestamp_ntz")


@query(
    "json_measurements",
    f"""SELECT 'summary' AS part, start AS "time", p5 AS a, median AS b, p95 AS c, count AS n
    FROM ({SUMMARY_SQL.format(v="throughput_mbps", where=DOWNLINK_SQL)})
  UNION ALL SELECT 'bucket', bucket, average, minimum, maximum, samples FROM ({SERIES_SQL})
  UNION ALL SELECT 'point', measured_at, round(latitude, 6), round(longitude, 6), round(throughput_mbps, 6), pci FROM m
    WHERE {DOWNLINK_SQL} AND throughput_mbps IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL""",
)
def json_measurements(spark, folder):
    """A whole measurement request as one JSON record: summary, points and series."""
    record = read_back(payloads.measurement_payload(view(spark, folder, "m"), DOWNLINK))
    summary = record.select(
        F.lit("summary").alias("part"), timed("summary.start").alias("time"),
        F.col("summary.p5").alias("a"), F.col("summary.median").alias("b"), F.col("summary.p95").alias("c"),
        F.col("summary.count").alias("n"),
    )
    buckets = record.select(F.explode("series").alias("s")).select(
        F.lit("bucket").alias("part"), timed("s.time").alias("time"),
        F.col("s.average").alias("a"), F.col("s.minimum").alias("b"), F.col("s.maximum").alias("c"), F.col("s.samples").alias("n"),
    )
    points_ = record.select(F.explode("points").alias("p")).select(
        F.lit("point").alias("part"), timed("p.measured_at").alias("time"),
        F.col("p.latitude").alias("a"), F.col("p.longitude").alias("b"), F.col("p.metric_value").alias("c"), F.col("p.pci").alias("n"),
    )
    return rounded(summary.unionByName(buckets).unionByName(points_), "a", "b", "c")
