"""Plans that matter at scale: pruning, pushdown, one scan, no global task."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from airgauge.operators import catalog, compare, facets, points, quantiles, running
from airgauge.operators.filters import Selection, select_rows, with_metric
from airgauge.session import fresh_folder, settle
from airgauge.sources import store
from workloads import compared, fixtures
from workloads.ingested import all_kinds

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def snapshots(spark, cache={}):
    if "root" not in cache:
        cache["root"] = fresh_folder(spark, "plans")
        store.replace_partitions(all_kinds(spark, FOLDER), cache["root"], "2026-06-10")
    return store.read_snapshots(spark, cache["root"])


SELECTION = {
    "database": "db_a", "collections": ["col_1", "col_2"], "technology": "NR", "operator": "op_1", "band": "NR:3",
    "start": "2024-01-02", "end": "2024-01-20",
}


def test_selection_prunes_and_pushes_down(spark):
    rows = with_metric(select_rows(snapshots(spark), Selection.of(SELECTION)), "rsrp_dbm")
    text = plan(quantiles.metric_summary(rows))
    partition_filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", text, re.S)[1]
    for column in ("measurement_type", "database_name", "collection_name"):
        assert column in partition_filters
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text, re.S)[1]
    for part in ("operator_name", "band_number", "rsrp_dbm", "GreaterThanOrEqual(measured_at", "LessThanOrEqual(measured_at"):
        assert part in pushed, pushed
    read = re.search(r"ReadSchema: struct<(.*?)>", text, re.S)[1]
    assert "latitude" not in read and "sinr_db" not in read


def test_compare_scans_once_and_counts_before_it_splits_curves(spark):
    matched = compare.match_curves(snapshots(spark), compare.curves_of(compared.REQUEST))
    text = plan(matched)
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert text.index("Generate explode(filter") < text.index("Exchange hashpartitioning")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_facets_scan_once(spark):
    selection = Selection.of({"database": "db_a", "collections": ["col_1"]})
    text = plan(facets.facet_cascade(snapshots(spark), selection))
    assert text.count("FileScan") == 1


def test_summary_combines_before_the_shuffle(spark):
    text = plan(quantiles.metric_summary(with_metric(snapshots(spark), "rsrp_dbm"), groups=["database_name"]))
    assert "partial_count" in text and text.count("Exchange") == 1


def test_ranked_quantiles_use_no_global_window(spark):
    rows = with_metric(snapshots(spark), "rsrp_dbm")
    text = plan(quantiles.ranked_quantiles(rows, "metric_value"))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", text)
    assert windows and all("slice" in w or "slice_weight" in text for w in windows)
    assert "SinglePartition" not in text.split("slice_weight")[0]


def test_key_filter_prunes_by_the_catalog(spark):
    keys = fixtures.partitions(spark, FOLDER).where(F.col("collection_name") == "col_1")
    root = fresh_folder(spark, "keys")
    keys.select("database_name", "collection_name", "measurement_type").write.parquet(root)
    listed = spark.read.parquet(root).where(F.col("database_name") == "db_a")
    text = plan(catalog.key_filter(snapshots(spark), listed))
    assert "LeftSemi" in text and "BroadcastHashJoin" in text and "dynamicpruning" in text


def scans_of(monkeypatch, *modules):
    """Plans of what is written down while a request runs."""
    plans = []

    def noted(df):
        plans.append(plan(df))
        return settle(df)

    for module in modules:
        monkeypatch.setattr(module, "settle", noted)
    return plans


def test_summary_percentiles_and_cdf_come_from_one_scan(spark, monkeypatch):
    rows = with_metric(snapshots(spark), "rsrp_dbm")
    plans = scans_of(monkeypatch, quantiles)
    counts = quantiles.histogram(rows, groups=["collection_name"])
    results = [
        quantiles.histogram_summary(counts, groups=["collection_name"]),
        quantiles.quantiles(counts, groups=["collection_name"], row_bound=10, weight="n"),
        quantiles.quantiles(counts, groups=["collection_name"], row_bound=10**9, weight="n"),
    ]
    assert [p.count("FileScan") for p in plans] == [1] and "partial_count" in plans[0]
    assert all("FileScan" not in plan(r) for r in results)
    for make in (quantiles.summary_with_marks, quantiles.quantiles):
        plans.clear()
        result = make(rows)
        assert sum(p.count("FileScan") for p in plans) == 1 and "FileScan" not in plan(result)


def test_ranks_are_found_without_whole_rows(spark, monkeypatch):
    """Only keys are counted and ordered; other columns are read once, for the wanted keys."""
    rows = snapshots(spark).select("measured_at", "operator_name", "pci", "model", "rsrp_dbm", "latitude", "cell_type")
    plans = scans_of(monkeypatch, points, running)
    # Many rows at few times, so that the times alone do not tell which rows are wanted.
    rows = rows.withColumn("measured_at", F.date_trunc("month", "measured_at").cast("timestamp_ntz"))
    result = points.thin_by_time(rows, 60, ties=["operator_name", "rsrp_dbm"], one_task_rows=0)
    assert len(plans) >= 4
    for text in plans:
        assert not re.search("latitude|cell_type|model|pci", text)
        keys = [s.count("ASC") for s in re.findall(r"Sort \[(.*?)\], (?:true|false)", text)]
        assert max(keys, default=0) <= 4  # the slice and three columns of the order
    whole = plan(result)
    assert "BroadcastHashJoin" in whole and "TakeOrderedAndProject" in whole and "SortMergeJoin" not in whole
    assert result.count() <= 60
