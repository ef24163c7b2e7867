"""Map points."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.operators import filters, points
from workloads.fixtures import view
from workloads.registry import query

POINTS_SQL = """SELECT {columns}, {metric} AS metric_value, event_id FROM m
  WHERE category = '{category}' AND {metric} IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL"""


def points_sql(category: str, metric: str) -> str:
    columns = [c for c in (*S.POINT_COLUMNS, *S.DETAIL_COLUMNS[category]) if c != "metric_value"]
    return POINTS_SQL.format(columns=", ".join(columns), metric=metric, category=category)


def located(spark, folder, category: str, metric: str):
    rows = view(spark, folder, "m").where(F.col("category") == category)
    return points.point_records(filters.with_metric(rows, metric), category, ["event_id"])


def _register(category: str, metric: str) -> None:
    @query(f"points_{category}", points_sql(category, metric))
    def run(spark, folder):
        return located(spark, folder, category, metric)


for _category, _metric in (
    ("radio", "sinr_db"),
    ("neighbor", "rssi_dbm"),
    ("pdsch", "bler"),
    ("pusch", "throughput_mbps"),
):
    _register(_category, _metric)

LIMIT = 580

THINNED_SQL = """SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn,
    count(*) OVER () AS total FROM ({source}))
  WHERE (rn - 1) % greatest(1, CAST(ceil(total / {limit}.0) AS BIGINT)) = 0 ORDER BY rn LIMIT {limit}"""

M_POINTS = """SELECT event_id, measured_at, latitude, longitude, rsrp_dbm FROM m
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""
M_THINNED = THINNED_SQL.format(
    columns="event_id, measured_at, latitude, longitude, rsrp_dbm",
    order="measured_at, event_id",
    source=M_POINTS,
    limit=LIMIT,
)


def map_rows(spark, folder):
    rows = view(spark, folder, "m").where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    return rows.select("event_id", "measured_at", "latitude", "longitude", "rsrp_dbm")


@query("downsample", M_THINNED)
def downsample(spark, folder):
    return points.thin_by_time(map_rows(spark, folder), LIMIT, ties=["event_id"])


@query("downsample_sliced", M_THINNED)
def downsample_sliced(spark, folder):
    """The form for large data: no task orders more than a slice."""
    return points.thin_by_time(map_rows(spark, folder), LIMIT, ties=["event_id"], one_task_rows=0)


TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "metric"]
MBIG_THINNED = THINNED_SQL.format(
    columns="measured_at, l_orderkey, l_linenumber, l_partkey, l_suppkey, pci, metric",
    order="measured_at, l_orderkey, l_linenumber, l_partkey, l_suppkey, metric",
    source="SELECT * FROM mbig",
    limit=points.POINT_LIMIT,
)


def many_rows(spark, folder):
    return view(spark, folder, "mbig").select("measured_at", *TIES[:4], "pci", "metric")


@query("downsample_all_rows", MBIG_THINNED, views=("mbig",))
def downsample_all_rows(spark, folder):
    """Many rows at the same time: ranks inside a time need the tie-break."""
    return points.thin_by_time(many_rows(spark, folder), ties=TIES)


@query("downsample_all_rows_sliced", MBIG_THINNED, views=("mbig",))
def downsample_all_rows_sliced(spark, folder):
    return points.thin_by_time(many_rows(spark, folder), ties=TIES, one_task_rows=0)


@query(
    "bounding_box",
    """SELECT min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east
  FROM m WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
)
def bounding_box(spark, folder):
    return points.bounding_box(map_rows(spark, folder))


