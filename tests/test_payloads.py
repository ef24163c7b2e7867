from __future__ import annotations

import json

from airgauge.plans import measurements as requests
from airgauge.plans import payloads
from workloads import compared, fixtures

FOLDER = "/root/testdata/sf0.001"
ARGUMENTS = {"database": "db_a", "collections": ["col_0", "col_1", "col_2"], "metric": "rsrp_dbm"}


def load(df):
    (row,) = payloads.as_json(df).collect()
    return json.loads(row.payload)


def m(spark):
    return fixtures.view(spark, FOLDER, "m")


def test_cdf(spark):
    got = load(payloads.cdf_payload(m(spark), ARGUMENTS))
    rows = requests.cdf(m(spark), ARGUMENTS).orderBy("position").collect()
    assert [(p["value"], p["probability"]) for p in got["points"]] == [(r.value, r.probability) for r in rows]
    assert (got["label"], got["unit"], len(rows)) == ("RSRP / SS-RSRP", "dBm", 401)
    empty = load(payloads.cdf_payload(m(spark), {**ARGUMENTS, "operator": "nobody"}))
    assert (empty["count"], empty["points"]) == (0, [])


def test_options(spark):
    got = load(payloads.options_payload(m(spark), ARGUMENTS))
    rows = requests.options(m(spark), ARGUMENTS).collect()
    for level, key in (("band", "bands"), ("pci", "pcis"), ("ssb", "ssb_indexes")):
        number = int if level == "pci" else str
        wanted = [{"value": number(r.value), "label": r.label} for r in rows if r.level == level]
        assert got[key] == wanted and wanted
    assert got["technologies"] == ["LTE", "NR"]
    assert got["operators"] == sorted(got["operators"]) and got["operators"]
    assert [x["value"] for x in got["metrics"]] == ["rsrp_dbm", "rsrq_db", "rssi_dbm", "sinr_db"]


def test_measurements(spark):
    arguments = {**ARGUMENTS, "operator": "op_1"}
    got = load(payloads.measurement_payload(m(spark), arguments))
    assert sum(b["samples"] for b in got["series"]) == got["summary"]["count"] > 0
    times = [p["measured_at"] for p in got["points"]]
    assert times == sorted(times) and "T" in times[0] and got["summary"]["start"] <= times[0]
    assert list(got["points"][0])[:4] == ["collection_name", "measured_at", "latitude", "longitude"]
    assert "ssb_index" in got["points"][0] and "cell_type" in got["points"][0]
    assert load(payloads.measurement_payload(m(spark), ARGUMENTS))["series"] == []
    nothing = load(payloads.measurement_payload(m(spark), {**ARGUMENTS, "database": "none"}))
    assert (nothing["summary"], nothing["points"], nothing["series"]) == ({"count": 0}, [], [])


def test_compare(spark):
    got = load(payloads.compare_payload(m(spark), compared.REQUEST, fixtures.partitions(spark, FOLDER)))
    assert got["curve_count"] == 8 and got["database"] == "db_a"
    titles = [c["title"] for c in got["charts"]]
    assert titles[0] == "Radio: RSRP / SS-RSRP" and len(titles) == len(set(titles)) == 5
    curves = [c for chart in got["charts"] for c in chart["curves"]]
    assert {c["position"] for c in curves} == set(range(8))
    for c in curves:
        assert len(c["points"]) == (401 if c["count"] else 0)
        assert (c["note"] is None) == (c["count"] > 0)


def test_catalog(spark):
    got = load(payloads.catalog_payload(fixtures.partitions(spark, FOLDER)))
    assert [d["name"] for d in got["databases"]] == ["db_a", "db_b"]
    names = [c["name"] for c in got["databases"][0]["collections"]]
    assert names == sorted(names) and names
    assert [x["value"] for x in got["measurements"]] == ["radio", "neighbor", "pdsch", "pusch"]
    assert sum(len(x["metrics"]) for x in got["measurements"]) == 17
