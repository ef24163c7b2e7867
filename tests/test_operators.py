from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airgauge.operators import compare, facets, fingerprint, points, quantiles, running, series
from airgauge.operators.filters import Selection, cleaned_list, select_rows, with_metric
from airgauge.plans import measurements as requests
from workloads.fixtures import view

FOLDER = "/root/testdata/sf0.001"
DAY = dt.datetime(2026, 6, 12)


def brute_quantiles(values, steps):
    return np.quantile(np.array(values, dtype=float), np.arange(steps + 1) / steps)


FORMS = {
    "built in": lambda r, g, s: quantiles.built_in_quantiles(r, "v", g, s),
    "one task": lambda r, g, s: quantiles.ranked_quantiles(r, "v", g, s, sliced=False),
    "sliced": lambda r, g, s: quantiles.ranked_quantiles(r, "v", g, s),
}


@pytest.mark.parametrize("form", FORMS)
def test_quantiles_of_hot_groups_and_values(spark, form):
    """One group and one value hold most rows; another group has a single row."""
    rng = random.Random(7)
    groups = {
        "hot": [5.0] * 3000 + [rng.gauss(0, 100) for _ in range(2000)],
        "small": [rng.gauss(0, 1) for _ in range(37)],
        "single": [4.25],
        "pair": [1.0, 2.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "g string, v double").repartition(7)
    got = FORMS[form](rows, ["g"], 400).collect()
    assert len(got) == 4 * 401
    for name, vs in groups.items():
        mine = [r.value for r in sorted((r for r in got if r.g == name), key=lambda r: r.position)]
        assert np.allclose(mine, brute_quantiles(vs, 400), rtol=0, atol=1e-9)


@pytest.mark.parametrize("form", FORMS)
def test_golden_percentiles(spark, form):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    marks = quantiles.percentile_columns(FORMS[form](rows, [], 20)).first()
    assert [round(x, 9) for x in marks] == [1.1, 2.0, 3.8]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.integers(1, 40))
def test_ranked_quantiles_property(spark, values, steps):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantiles.ranked_quantiles(rows, "v", [], steps, sliced=False).orderBy("position").collect()
    assert np.allclose([r.value for r in got], brute_quantiles(values, steps), atol=1e-6)
    assert got[0].value == min(values) and got[-1].value == max(values)


def test_quantiles_of_no_rows(spark):
    rows = spark.createDataFrame([(None,)], "v double")
    assert quantiles.quantiles(rows, "v", ["v"]).count() == 0
    assert quantiles.ranked_quantiles(rows.where("v IS NOT NULL"), "v").count() == 0


@pytest.mark.parametrize("sliced", [True, False])
def test_running_totals(spark, sliced):
    rng = random.Random(3)
    data = [(f"g{i % 3}" if i % 2 else None, i, rng.randint(1, 9)) for i in range(3000)]
    rows = spark.createDataFrame(data, "g string, k int, n bigint").repartition(5, "n")
    got = running.running_totals(rows, ["k"], "n", ["g"], sliced=sliced).collect()
    before, total = {}, {}
    for g, _, n in data:
        total[g] = total.get(g, 0) + n
    assert len(got) == len(data)
    for r in sorted(got, key=lambda r: r.k):
        assert (r.before, r.total) == (before.get(r.g, 0), total[r.g])
        before[r.g] = r.before + r.n


def brute_thin(data, limit):
    ordered = sorted(data)
    stride = max(1, -(-len(ordered) // limit))
    return ordered[::stride][:limit]


@pytest.mark.parametrize("one_task_rows", [0, 10**9])
@pytest.mark.parametrize("limit", [7, 100, 999, 5000])
def test_thinning_with_hot_time_and_copies(spark, one_task_rows, limit):
    """A third of the rows at one time, a third copies of one row."""
    rng = random.Random(11)
    hot = [(DAY, rng.randint(0, 50), rng.random()) for _ in range(1000)]
    copies = [(DAY + dt.timedelta(seconds=5), 1, 0.5)] * 1000
    spread = [(DAY + dt.timedelta(seconds=rng.randint(-500, 500)), i, rng.random()) for i in range(1000)]
    data = hot + copies + spread
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "measured_at timestamp_ntz, a int, b double").repartition(6)
    got = points.thin_by_time(rows, limit, one_task_rows=one_task_rows).collect()
    assert [tuple(r) for r in got] == brute_thin(data, limit)


@pytest.mark.parametrize("total, kept", [(6000, 6000), (6001, 3001)])
def test_thinning_golden_sizes(spark, total, kept):
    rows = spark.range(total).select(
        (F.lit("2026-06-12").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id)")).alias("measured_at"),
        "id",
    )
    got = points.thin_by_time(rows).collect()
    assert len(got) == kept and got[0].id == 0


@pytest.mark.parametrize(
    "seconds, width", [(0, 1), (-5, 1), (500, 1), (501, 2), (86400, 300), (600 * 86400, 86400)]
)
def test_bucket_width(spark, seconds, width):
    assert series.bucket_width(seconds) == width
    assert spark.range(1).select(series.bucket_width_of(F.lit(seconds))).first()[0] == width


def test_scale_position_of_equal_ends(spark):
    def at(v, lo, hi):
        return points.scale_position(F.lit(v), F.lit(lo), F.lit(hi))

    row = spark.range(1).select(at(5.0, 5.0, 5.0), at(9.0, 0.0, 4.0), at(1.0, 0.0, 4.0)).first()
    assert tuple(row) == (0.0, 1.0, 0.25)


def test_tens_extent(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 41.0), ("b", 20.0)], "g string, value double")
    got = {r.g: (r.minimum, r.maximum) for r in quantiles.tens_extent(rows, groups=["g"]).collect()}
    assert got == {"a": (0, 50), "b": (20, 30)}


def test_fingerprint_sees_every_cell(spark):
    data = [(DAY, i, float(i) if i % 3 else None) for i in range(200)]
    struct = "measured_at timestamp_ntz, a int, b double"

    def mark(rows):
        frame = spark.createDataFrame(rows, struct).withColumn("k", F.lit("x"))
        summary = fingerprint.partition_summaries(frame, ["k"], fingerprint.row_text(["measured_at", "a", "b"]))
        return summary.select(fingerprint.fingerprint(F.col("k"), F.lit("measured_at,a,b"))).first()[0]

    base = mark(data)
    assert mark(list(reversed(data))) == base
    assert mark(data[:50] + [(DAY, 50, None)] + data[51:]) != base
    assert mark(data[:50] + [(DAY, 51, 50.0)] + data[51:]) != base
    assert mark(data[:50] + [(DAY + dt.timedelta(microseconds=1), 50, 50.0)] + data[51:]) != base
    assert mark(data + [data[1]]) != base
    assert mark(data + [data[1], data[1]]) != base


# --- selections ---


def test_arguments_are_cleaned():
    assert cleaned_list(["a", "", "all", None, "b", "a"]) == ("a", "b")
    s = Selection.of({"database": "d", "collections": ["c"], "technology": "lte", "band": "all", "pci": ""})
    assert (s.technology, s.band, s.pci) == ("LTE", None, None)
    assert s.kinds() == ("lte_radio",)


@pytest.mark.parametrize(
    "wrong",
    [
        {"technology": "5g"}, {"measurement": "wifi"}, {"band": "XX:3"}, {"band": "LTE:x"}, {"band": "b3"},
        {"pci": "one"}, {"ssb": "two"}, {"database": ""}, {"collections": []},
    ],
)
def test_wrong_arguments(spark, wrong):
    with pytest.raises(ValueError):
        Selection.of({"database": "d", "collections": ["c"], **wrong})


def test_wrong_metric(spark):
    m = view(spark, FOLDER, "m")
    with pytest.raises(ValueError, match="metric"):
        requests.cdf(m, {"database": "db_a", "collections": ["col_1"], "metric": "bler"})
    with pytest.raises(ValueError, match="metric"):
        requests.cdf(m, {"database": "db_a", "collections": ["col_1"]})


def test_measurements_of_nothing(spark):
    got = requests.measurements(
        view(spark, FOLDER, "m"), {"database": "none", "collections": ["x"], "metric": "rsrp_dbm"}
    )
    assert got.summary == {"count": 0} and got.points is None and got.series is None


def test_series_needs_an_operator(spark):
    arguments = {"database": "db_a", "collections": ["col_0", "col_1"], "metric": "rsrp_dbm"}
    m = view(spark, FOLDER, "m")
    without = requests.measurements(m, arguments)
    assert without.series is None and without.points.count() == without.summary["located"]
    one = requests.measurements(m, {**arguments, "operator": "op_0"})
    assert sum(r.samples for r in one.series.collect()) == one.summary["count"]


# --- choices ---


def test_stale_choices_restrict_nothing(spark):
    m = view(spark, FOLDER, "m")
    base = {"database": "db_a", "collections": ["col_0", "col_1", "col_2"]}
    plain = [tuple(r) for r in requests.options(m, base).collect()]
    stale = {"technology": "wimax", "operator": "nobody", "band": "bad", "pci": "x", "ssb": "77"}
    assert [tuple(r) for r in requests.options(m, {**base, **stale}).collect()] == plain


def test_choices_are_ordered(spark):
    rows = requests.options(
        view(spark, FOLDER, "m"), {"database": "db_a", "collections": ["col_0", "col_1", "col_2"]}
    ).collect()
    pcis = [int(r.value) for r in rows if r.level == "pci"]
    assert pcis == sorted(pcis) and pcis
    ssb = [r.value for r in rows if r.level == "ssb"]
    assert ssb[-1] == "__null__" and ssb[:-1] == sorted(ssb[:-1], key=int)
    bands = [r.value for r in rows if r.level == "band"]
    assert bands == sorted(bands, key=lambda b: (b.split(":")[0], int(b.split(":")[1])))


def test_facet_counts_add_up(spark):
    m = view(spark, FOLDER, "m")
    selection = Selection.of({"database": "db_a", "collections": ["col_0", "col_1"]})
    total = select_rows(m, selection).count()
    rows = facets.facet_cascade(m, selection).collect()
    assert sum(r.n for r in rows if r.level == "ssb") == total
    assert sum(r.n for r in rows if r.level == "technology") == total


# --- compare ---


def curve(**fields):
    return {"metric": "rsrp_dbm", "collections": ["col_0"], **fields}


@pytest.mark.parametrize(
    "request_",
    [
        {"curves": [curve()]},
        {"database": "db_a", "curves": []},
        {"database": "db_a", "curves": [curve()] * 21},
        {"database": "db_a", "curves": ["text"]},
        {"database": "db_a", "curves": [{"collections": ["col_0"]}]},
        {"database": "db_a", "curves": [{"metric": "rsrp_dbm"}]},
        {"database": "db_a", "curves": [curve(metric="bler")]},
        {"database": "db_a", "curves": [curve(technology="x")]},
    ],
)
def test_wrong_compare_requests(spark, request_):
    with pytest.raises(ValueError):
        compare.curves_of(request_)


def test_twenty_curves_match_single_queries(spark):
    m = view(spark, FOLDER, "m")
    options = [{"operator": f"op_{i % 3}", "technology": ("LTE", "NR")[i % 2]} for i in range(20)]
    for i, o in enumerate(options):
        o["collections"] = [f"col_{j}" for j in range(i % 5 + 1)]
        o["metric"] = ("rsrp_dbm", "sinr_db")[i % 4 // 2]
    request = {"database": "db_b", "curves": [curve(**o) for o in options]}
    curves = compare.curves_of(request)
    counts = {
        r.position: r.n
        for r in compare.match_curves(m, curves).groupBy("position").agg(F.sum("n").alias("n")).collect()
    }
    for c in curves:
        expected = with_metric(select_rows(m, c.selection), c.metric).count()
        assert counts.get(c.position, 0) == expected


def test_compare_line_text(spark):
    rows = spark.createDataFrame(
        [(1200, 1.5, -3.25, 10.0, "dB", None), (0, None, None, None, "dB", "No matching rows"), (2, 1.0, 1.0, 1.0, "", None)],
        "count bigint, median double, p5 double, p95 double, unit string, note string",
    )
    assert [r[0] for r in rows.select(compare.curve_text(rows)).collect()] == [
        "1,200 samples | Median 1.5 dB (P5 -3.25 dB | P95 10 dB)",
        "No matching rows",
        "2 samples | Median 1 (P5 1 | P95 1)",
    ]


def test_thinning_of_many_times_with_few_rows_each(spark):
    """Sliced totals, but the rows at the wanted times fit one task."""
    data = [(DAY + dt.timedelta(seconds=i // 3), i % 3, i / 7) for i in range(3000)]
    rows = spark.createDataFrame(data, "measured_at timestamp_ntz, a int, b double").repartition(6)
    got = points.thin_by_time(rows, 50, one_task_rows=200).collect()
    assert [tuple(r) for r in got] == brute_thin(data, 50)
