"""Staging of dropped exports: from the files to what is to be done with each."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgauge.functions import names
from airgauge.session import settle
from airgauge.sources import exports, store


def checked_export_date(text: str) -> str:
    """An export date as folders carry it: YYYYMMDD or YYYYMMDD-HHMM, and a day that exists."""
    if re.fullmatch(r"\d{8}(-\d{4})?", text):
        try:
            datetime.strptime(text, "%Y%m%d-%H%M" if "-" in text else "%Y%m%d")
            return text
        except ValueError:
            pass
    raise ValueError(f"{text} is no export date YYYYMMDD or YYYYMMDD-HHMM")


def staging(
    spark: SparkSession, drop_folder: str, archive: str, export_date: str, force: bool = False
) -> DataFrame:
    """What becomes of each CSV file that lies in ``drop_folder``.

    A file's database is its first non-blank one, its stem the archived form of its name;
    together with the date they make its ``target`` below ``archive``. ``action`` is STAGE,
    SKIP (the target has the same bytes), CONFLICT (it has others, and no ``force``) or
    ERROR with the ``problem``. Files count in the order of their paths.
    """
    date = checked_export_date(export_date)
    folder = drop_folder.rstrip("/").rsplit("/", 1)[-1]

    def dropped(path: Column) -> Column:
        return names.is_csv(path) & (names.export_folder(path) == folder)

    listed = exports.list_files(spark, [drop_folder]).where(dropped(F.col("path")))
    read = exports.contents(spark, [drop_folder], dropped).select("path", "uri", "file_hash", "header", "multi_line")
    files = settle(listed.select("path").join(read, "path", "left"))
    headed = files.where(F.trim("header") != "")
    databases = exports.first_databases(spark, headed).drop("uri")
    stem = names.archive_stem(F.col("path"))
    about = files.join(databases, "path", "left").select(
        "path",
        "file_hash",
        stem.alias("stem"),
        names.stem_kind(stem).alias("kind"),
        F.col("value").alias("database"),
        F.when(stem.isNull(), F.lit("unknown file name"))
        .when(F.col("file_hash").isNull(), F.lit("too large"))
        .when(F.trim("header") == "", F.lit("no header line"))
        .when(~F.col("has_column"), F.lit("no Database column"))
        .when(F.col("value").isNull(), F.lit("no Database value"))
        .alias("problem"),
    )
    target = F.when(
        F.col("problem").isNull(), F.concat_ws("/", "database", F.lit(date), F.concat("stem", F.lit(".csv")))
    )
    about = settle(about.withColumn("target", target))
    return decided(about, archived_files(spark, archive, date), force)


def archived_files(spark: SparkSession, archive: str, date: str) -> DataFrame:
    """Archived files of an export date: (target, file_hash)."""
    if not store.exists(spark, archive):
        return spark.createDataFrame([], "target string, file_hash string")
    held = exports.contents(spark, [archive], lambda path: names.is_csv(path) & (names.export_folder(path) == date))
    return held.select(F.substring_index("path", "/", -3).alias("target"), "file_hash")


def decided(files: DataFrame, archived: DataFrame, force: bool = False) -> DataFrame:
    """``files`` (path, target, file_hash, problem, ..) with the action for each."""
    good = files.where(F.col("problem").isNull())
    plan = exports.staging_plan(good.select("target", "path", "file_hash"), archived, force)
    return files.join(plan.select("path", "action"), "path", "left").withColumn(
        "action", F.coalesce("action", F.lit("ERROR"))
    )
