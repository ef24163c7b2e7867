from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from airgauge.functions import casts, labels, names


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(F.expr(expression)).collect()]


def test_bigint(spark):
    texts = ["12.7", "12.5", "-12.5", "1e2", " 7 ", "n41", "", None, "9223372036854775808", "41.0"]
    assert values(spark, texts, casts.bigint("t")) == [
        13, 13, -13, 100, 7, None, None, None, None, 41,
    ]


def test_double(spark):
    got = values(spark, [" 1.5 ", "abc", "1d", "1f", "-inf", "NaN", ""], casts.double("t"))
    assert got[:5] == [1.5, None, None, None, -math.inf]
    assert math.isnan(got[5]) and got[6] is None


def test_flag(spark):
    texts = ["T", "yes", "0", " true ", "on", "FALSE", None]
    assert values(spark, texts, casts.flag("t")) == [True, True, False, None, None, False, None]


def test_time(spark):
    texts = [
        "2026-06-12T10:00:01Z", "2026-06-12 10:00:03+02:00", "2026/06/12 10:00:00", "2026",
        "12/06/2026 10:00", "2026-06-12 24:00:00", "2026-06", "2026-02-30 10:00:00", "2026-06-12", "",
    ]
    day = dt.datetime(2026, 6, 12)
    assert values(spark, texts, casts.time("t")) == [
        day.replace(hour=10, second=1), day.replace(hour=10, second=3), day.replace(hour=10), None,
        None, dt.datetime(2026, 6, 13), None, None, day, None,
    ]


def test_time_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, ["2026-03-08 02:30:00"], casts.time("t")) == [
            dt.datetime(2026, 3, 8, 2, 30)
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_clean_text(spark):
    assert values(spark, ["  a b ", "   ", "", None], casts.clean_text("t")) == ["a b", None, None, None]


def test_quoted_text_stays_text(spark):
    text = "it's \\ \"late\" \\n"
    row = spark.range(1).selectExpr(casts.quoted(text), casts.time(casts.quoted(text))).first()
    assert tuple(row) == (text, None)


@pytest.mark.parametrize(
    "path, kind, stem",
    [
        ("x/20260101/lte_radio.csv", "lte_radio", "lte_radio"),
        ("x/20260101/NR_Radio_Neig.CSV", "nr_radio_neighbor", "nr_radio_neig"),
        ("x/LTE PDSCH [per-carrier].csv", None, "lte_pdsch"),
        ("x/NR Radio Beam.csv", None, "nr_radio_neig"),
        ("x/LTE Radio [connected].csv", None, "lte_radio"),
        ("x/notes.csv", None, None),
    ],
)
def test_file_names(spark, path, kind, stem):
    p = F.lit(path)
    row = spark.range(1).select(names.kind_from_path(p), names.archive_stem(p), names.is_csv(p)).first()
    assert tuple(row) == (kind, stem, True)


@pytest.mark.parametrize(
    "folder, time",
    [
        ("20260612", dt.datetime(2026, 6, 12)),
        ("20260612-1030", dt.datetime(2026, 6, 12, 10, 30)),
        ("20260612-2460", None),
        ("20260230", None),
        ("2026061", None),
        ("latest", None),
    ],
)
def test_export_folder(spark, folder, time):
    row = spark.range(1).select(
        names.folder_time(F.lit(folder)), names.is_export_date(F.lit(folder))
    ).first()
    assert tuple(row) == (time, time is not None)


def test_drop_folder_is_a_whole_path_part(spark):
    row = spark.range(1).select(
        names.in_drop_folder(F.lit("data/_temp/a.csv")), names.in_drop_folder(F.lit("data/my_temp/a.csv"))
    ).first()
    assert tuple(row) == (True, False)


def test_labels(spark):
    row = spark.range(1).select(
        labels.counted(labels.band_text(F.lit("NR"), F.lit(41)), F.lit(12345)),
        labels.technology_counts(F.lit(2), F.lit(0)),
        labels.technology_counts(F.lit(0), F.lit(None).cast("int")),
        labels.null_choice(F.lit(None).cast("bigint")),
    ).first()
    assert tuple(row) == ("n41 (#12,345)", "LTE(#2)", "-", "__null__")


def test_natural_order(spark):
    texts = ["run 10", "Run 2", "run 1b", "alpha", "run 0003"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.t for r in rows.orderBy(labels.natural_key(F.col("t"))).collect()]
    assert got == ["alpha", "run 1b", "Run 2", "run 0003", "run 10"]
