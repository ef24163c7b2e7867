"""Measurement-shaped views of the given tables, as SQL both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

M = """
WITH b AS (
  SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'LTE' ELSE 'NR' END AS technology,
         CASE event_id % 4 WHEN 0 THEN 'radio' WHEN 1 THEN 'neighbor'
                           WHEN 2 THEN 'pdsch' ELSE 'pusch' END AS category
  FROM events)
SELECT event_id, ts AS measured_at, category, technology,
  concat(lower(technology), '_',
         CASE category WHEN 'neighbor' THEN 'radio_neighbor' ELSE category END) AS measurement_type,
  CASE WHEN user_id % 2 = 0 THEN 'db_a' ELSE 'db_b' END AS database_name,
  concat('col_', CAST(user_id % 5 AS STRING)) AS collection_name,
  CASE WHEN event_id % 13 = 0 THEN NULL
       ELSE CAST(38 AS DOUBLE) + CAST(event_id % 1000 AS DOUBLE) / CAST(100 AS DOUBLE) END AS latitude,
  CASE WHEN event_id % 13 = 0 THEN NULL
       ELSE CAST(-80 AS DOUBLE) - CAST(event_id % 700 AS DOUBLE) / CAST(100 AS DOUBLE) END AS longitude,
  concat('op_', CAST(user_id % 3 AS STRING)) AS operator_name,
  concat('phone_', CAST(user_id % 4 AS STRING)) AS model,
  CASE WHEN technology = 'LTE' THEN 'LTE' ELSE 'NSA' END AS rat,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 6 + 1 END AS band_number,
  user_id AS pci,
  CASE WHEN technology = 'LTE' OR event_id % 7 = 0 THEN NULL ELSE event_id % 8 END AS ssb_index,
  event_id % 3000 AS dl_channel_number,
  event_id % 3000 + 18000 AS ul_channel_number,
  CAST((event_id % 4 + 1) * 5 AS DOUBLE) AS dl_bandwidth_mhz,
  CAST((event_id % 4 + 1) * 10 AS DOUBLE) AS dl_bandwidth_aggregated_mhz,
  CAST((event_id % 2 + 1) * 5 AS DOUBLE) AS ul_bandwidth_mhz,
  CAST((event_id % 2 + 1) * 10 AS DOUBLE) AS ul_bandwidth_aggregated_mhz,
  CASE WHEN technology = 'LTE' THEN CAST(15 AS BIGINT) ELSE CAST(30 AS BIGINT) END AS dl_scs_khz,
  CASE WHEN technology = 'LTE' THEN CAST(15 AS BIGINT) ELSE CAST(30 AS BIGINT) END AS ul_scs_khz,
  CASE WHEN event_id % 3 = 0 THEN 'PCell' ELSE 'SCell' END AS cell_type,
  CASE WHEN technology = 'LTE' THEN NULL ELSE event_id % 5 = 0 END AS is_serving_beam,
  CASE event_id % 3 WHEN 0 THEN 'QPSK' WHEN 1 THEN '64QAM' ELSE '256QAM' END AS modulation,
  CAST(-140 AS DOUBLE) + value / CAST(5 AS DOUBLE) AS rsrp_dbm,
  CAST(-20 AS DOUBLE) + CAST(event_id % 170 AS DOUBLE) / CAST(10 AS DOUBLE) AS rsrq_db,
  CASE WHEN technology = 'NR' THEN NULL ELSE CAST(-(event_id % 60) - 50 AS DOUBLE) END AS rssi_dbm,
  CASE WHEN technology = 'LTE' AND category = 'neighbor' THEN NULL
       ELSE CAST(event_id % 50 AS DOUBLE) - CAST(10 AS DOUBLE) END AS sinr_db,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS throughput_mbps,
  CAST(event_id % 28 AS DOUBLE) AS mcs,
  CAST(event_id % 4 + 1 AS DOUBLE) AS avg_pdsch_layers,
  CAST(event_id % 2 + 1 AS DOUBLE) AS avg_pusch_layers,
  CAST(event_id % 100 AS DOUBLE) AS pdsch_rbs,
  CAST(event_id % 50 AS DOUBLE) AS pusch_rbs,
  CAST(event_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS bler
FROM b
"""

RAW = """
SELECT event_id,
  CASE WHEN event_id % 97 = 0 THEN 'bad time'
       ELSE concat('2026-06-', CAST(10 + event_id % 20 AS STRING), ' 10:00:00') END AS time_text,
  CASE WHEN event_id % 2 = 0 THEN ' Db1 ' ELSE 'Db2' END AS database_text,
  CASE WHEN event_id % 89 = 0 THEN '   ' ELSE concat('c', CAST(user_id % 5 AS STRING)) END AS collection_text,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '12.7' WHEN 2 THEN ' 7 ' WHEN 3 THEN 'n41'
       WHEN 4 THEN '-12.5' WHEN 5 THEN '1e2' ELSE CAST(user_id AS STRING) END AS pci_text,
  CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN ' 1500.5 '
       ELSE CAST(event_id * 10 AS STRING) END AS throughput_kbps_text,
  CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN 'yes'
       WHEN 3 THEN 'maybe' WHEN 4 THEN 'F' ELSE NULL END AS beam_text,
  CASE event_id % 4 WHEN 0 THEN ' capacity' WHEN 1 THEN 'OOKLA(R)' WHEN 2 THEN 'Ping' ELSE NULL END AS test_name,
  CASE WHEN event_id % 3 = 0 THEN 'Uplink' ELSE 'downlink ' END AS direction,
  CASE WHEN event_id % 8 = 0 THEN 'Failed' ELSE 'Completed' END AS test_status
FROM events
"""

EXPORTS = """
SELECT o_orderkey AS delivery_id,
  concat('data/', CASE WHEN o_orderkey % 10 = 0 THEN '_temp' ELSE '_csvs' END,
         '/Db', CAST(o_custkey % 4 AS STRING), '/202606', CAST(10 + o_orderkey % 20 AS STRING),
         CASE WHEN o_orderkey % 3 = 0 THEN '-1030' ELSE '' END, '/',
         CASE o_orderkey % 6 WHEN 0 THEN 'lte_radio' WHEN 1 THEN 'LTE Radio Neig'
              WHEN 2 THEN 'NR PDSCH [per-carrier]' WHEN 3 THEN 'nr_pusch'
              WHEN 4 THEN 'NR Radio Beam' ELSE 'notes' END,
         CASE WHEN o_orderkey % 5 = 0 THEN '.CSV' WHEN o_orderkey % 7 = 0 THEN '.txt' ELSE '.csv' END) AS path,
  concat('col_', CAST(o_custkey % 8 AS STRING)) AS collection_name,
  md5(CAST(o_orderkey % 50 AS STRING)) AS file_hash
FROM orders
"""

MBIG = """
SELECT l_shipdate AS measured_at, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linestatus = 'O' THEN 'db_a' ELSE 'db_b' END AS database_name,
  concat('col_', CAST(l_suppkey % 7 AS STRING)) AS collection_name,
  CASE WHEN l_returnflag = 'N' THEN 'NR' ELSE 'LTE' END AS technology,
  concat('op_', CAST(l_partkey % 3 AS STRING)) AS operator_name,
  CAST(l_linenumber AS BIGINT) AS band_number,
  l_partkey % 504 AS pci,
  l_extendedprice AS metric
FROM lineitem
"""

# A partition catalog and the collections in it, from M.
PARTITIONS = """
SELECT database_name, collection_name, measurement_type, 2 AS schema_version,
  DATE '2026-06-10' AS export_date,
  TIMESTAMP_NTZ '2026-06-10 10:30:00' AS exported_at,
  count(*) AS row_count, min(measured_at) AS start_time, max(measured_at) AS end_time,
  md5(concat(database_name, collection_name, measurement_type)) AS content_hash,
  '' AS source_file_hash,
  concat(measurement_type, '/', database_name, '/', collection_name) AS parquet_path
FROM m GROUP BY database_name, collection_name, measurement_type
"""

_VIEWS = {"m": (M, "events"), "raw": (RAW, "events"), "exports": (EXPORTS, "orders"), "mbig": (MBIG, "lineitem")}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fixture view over the parquet tables in ``folder``."""
    text, table = _VIEWS[name]
    source = f"airgauge_{table}"
    spark.read.parquet(f"{folder}/{table}.parquet").createOrReplaceTempView(source)
    return spark.sql(text.replace(f"FROM {table}", f"FROM {source}"))


def partitions(spark: SparkSession, folder: str) -> DataFrame:
    view(spark, folder, "m").createOrReplaceTempView("airgauge_m")
    return spark.sql(PARTITIONS.replace("FROM m", "FROM airgauge_m"))


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL in which the named views can be used."""
    texts = {**{k: v[0] for k, v in _VIEWS.items()}, "p": PARTITIONS.replace("TIMESTAMP_NTZ", "TIMESTAMP")}
    needed = list(names)
    if "p" in needed and "m" not in needed:
        needed.insert(0, "m")
    parts = ", ".join(f"{n} AS ({texts[n]})" for n in needed)
    return f"WITH {parts} {sql}"
