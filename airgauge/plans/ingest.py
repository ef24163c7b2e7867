"""Import of exports: from files to replaced snapshots and an updated catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.functions.names import lookup
from airgauge.operators.fingerprint import fingerprint, partition_summaries, row_text
from airgauge.session import broadcast_if_small, fresh_folder, settle
from airgauge.sources import exports, store

SOURCE = exports.SOURCE_PATH
_EPOCH = "1970-01-01 00:00:00"


def latest_snapshots(deliveries: DataFrame, key: Sequence[str] = S.PARTITION_KEY) -> DataFrame:
    """The delivery that counts for each key: the newest, then the lowest path.

    An aggregation that combines before the shuffle, because one partition may
    have been delivered very often.
    """
    fields = [c for c in deliveries.columns if c not in key]
    age = -F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col("exported_at"))
    best = deliveries.groupBy(*key).agg(
        F.min_by(F.struct(*fields), F.struct(age, "path")).alias("d")
    )
    return best.select(*key, *[F.col(f"d.{c}").alias(c) for c in fields])


def snapshot_actions(incoming: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """Decide for each incoming snapshot: ADD, REPLACE or one of two SKIPs."""
    renamed = {
        "content_hash": "current_hash",
        "exported_at": "current_exported_at",
        "schema_version": "current_version",
        "parquet_path": "current_path",
    }
    known = current.select(
        *S.PARTITION_KEY, *[F.col(old).alias(new) for old, new in renamed.items() if old in current.columns]
    )
    older = F.col("exported_at") < F.col("current_exported_at")
    unchanged = (
        F.lit(not force)
        & (F.col("current_hash") == F.col("content_hash"))
        & (F.col("current_version") == S.SCHEMA_VERSION)
    )
    action = (
        F.when(F.col("current_hash").isNull(), F.lit("ADD"))
        .when(older, F.lit("SKIP older"))
        .when(unchanged, F.lit("SKIP unchanged"))
        .otherwise(F.lit("REPLACE"))
    )
    return incoming.join(known, list(S.PARTITION_KEY), "left").withColumn("action", action)


def file_summaries(rows: DataFrame) -> DataFrame:
    """Summary, fingerprint and invalid rows of each partition in each file.

    ``rows`` are canonical rows of all kinds; the text that is hashed holds the columns of
    the row's own kind.
    """
    kind = F.col("measurement_type")
    columns = {name: S.measurement_struct(name).names for name in S.KINDS}
    text = F.coalesce(*[F.when(kind == name, row_text(own)) for name, own in columns.items()])
    lacking = F.count_if(
        F.col("measured_at").isNull() | F.col("database_name").isNull() | F.col("collection_name").isNull()
    )
    keys = ["measurement_type", "database_name", "collection_name", SOURCE]
    summaries = partition_summaries(rows, keys, text, lacking.alias("invalid"))
    listed = lookup(kind, {name: ",".join(own) for name, own in columns.items()})
    return summaries.withColumn("content_hash", fingerprint(kind, listed))


def ingest(
    spark: SparkSession, paths: Sequence[str], root: str, force: bool = False, set_aside: bool = False
) -> DataFrame:
    """Import export files or folders into the store at ``root``.

    Returns the action taken for each partition. All files are checked before anything is
    written; one that cannot be imported is an error and stops the import, or, with
    ``set_aside``, is listed in a table of its own (``store.set_aside_table``) while the
    others go in. The new rows are written to folders that nothing reads yet. Then the
    partition catalog names them, in one step, and then the processed files are listed: a
    run that breaks off can simply be repeated. Each raw file is read twice, for its hash and for
    its rows, which are written down once in canonical form.
    """
    described = settle(exports.described(spark, paths))
    good = described.where(F.col("problem").isNull())
    if not force:
        processed = store.files_table(spark, root).read()
        good = exports.newest_copies(exports.unprocessed(good, processed))
    files = settle(good)

    folder = fresh_folder(spark, "canonical")
    canonical = exports.read_canonical(spark, files)
    canonical.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(canonical.schema).parquet(folder)
    summaries = settle(file_summaries(rows))
    bad = settle(_problems(described, summaries))
    if not set_aside:
        _require_none(bad)
    files = files.join(broadcast_if_small(bad.select("path")), "path", "left_anti")

    about = files.select(F.col("uri").alias(SOURCE), "path", "exported_at", "file_hash")
    deliveries = summaries.join(about, SOURCE)
    current = store.partitions_table(spark, root).read()
    plan = settle(snapshot_actions(latest_snapshots(deliveries), current, force))

    changed = plan.where(F.col("action").isin("ADD", "REPLACE"))
    run = "none"
    if not changed.isEmpty():
        run = store.write_snapshots(rows, root, changed.select(*S.PARTITION_KEY, SOURCE, "row_count"))
    if not plan.isEmpty():
        store.partitions_table(spark, root).upsert(_catalog_rows(plan, run), newest="exported_at")
    if not files.isEmpty():
        store.files_table(spark, root).upsert(_file_rows(files))
    if set_aside:
        _list_set_aside(spark, root, described, bad)
    return plan.select(*S.PARTITION_KEY, "action", "row_count", "exported_at")


def _problems(described: DataFrame, summaries: DataFrame) -> DataFrame:
    """Files (path, problem) that cannot be imported."""
    invalid = summaries.groupBy(F.col(SOURCE).alias("uri")).agg(F.sum("invalid").alias("invalid")).where("invalid > 0")
    incomplete = F.concat(F.col("invalid").cast("string"), F.lit(" rows without a time, database or collection"))
    unreadable = described.where(F.col("problem").isNotNull()).select("path", "problem")
    return unreadable.unionByName(described.join(invalid, "uri").select("path", incomplete.alias("problem")))


def _require_none(bad: DataFrame, shown: int = 20) -> None:
    first = bad.orderBy("path").limit(shown + 1).collect()
    if first:
        texts = [f"{r.path}: {r.problem}" for r in first[:shown]]
        raise ValueError("; ".join(texts) + ("; and more" if len(first) > shown else ""))


def _list_set_aside(spark: SparkSession, root: str, described: DataFrame, bad: DataFrame) -> None:
    """Files of this import leave the table of files set aside, or enter it again."""
    table = store.set_aside_table(spark, root)
    if bad.isEmpty() and table.read().isEmpty():
        return
    rows = settle(
        described.drop("problem")
        .join(bad, "path")
        .select(
            "path", F.col("kind").alias("measurement_type"), "file_hash", "problem", "length", "modified_at",
            F.current_timestamp().alias("processed_at"),
        )
    )
    table.change(lambda before: before.join(described.select("path"), "path", "left_anti").unionByName(rows))


def retry_set_aside(spark: SparkSession, root: str) -> DataFrame | None:
    """Import the files set aside that were changed since; None if there are none.

    Files that are gone leave the table. The driver gets the paths of the files set aside.
    """
    table = store.set_aside_table(spark, root)
    before = {r.path: (r.length, r.modified_at) for r in table.read().collect()}
    folders = sorted({path.rsplit("/", 1)[0] for path in before})
    there = [folder for folder in folders if store.exists(spark, folder)]
    if not before:
        return None
    now = {}
    if there:
        listed = exports.list_files(spark, there).where(F.col("path").isin(*before))
        now = {r.path: (r.length, r.modified_at) for r in listed.collect()}
    gone = sorted(set(before) - set(now))
    if gone:
        table.change(lambda rows: rows.where(~F.col("path").isin(*gone)))
    mended = [path for path, state in now.items() if state != before[path]]
    return ingest(spark, mended, root, set_aside=True) if mended else None


def _catalog_rows(plan: DataFrame, run: str) -> DataFrame:
    """Catalog rows of a plan; a partition that did not change keeps its folder."""
    path = F.when(F.col("action") == "SKIP unchanged", F.col("current_path")).otherwise(store.snapshot_path(run))
    return plan.where(F.col("action") != "SKIP older").select(
        *S.PARTITION_KEY,
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        F.col("exported_at").cast("date").alias("export_date"),
        "exported_at",
        "row_count",
        "start_time",
        "end_time",
        "content_hash",
        F.col("file_hash").alias("source_file_hash"),
        path.alias("parquet_path"),
        F.current_timestamp().alias("processed_at"),
    )


def _file_rows(files: DataFrame) -> DataFrame:
    """Processed files; of equal bytes, the one processed last is kept."""
    rows = files.groupBy("file_hash", F.col("kind").alias("measurement_type")).agg(
        F.min_by("path", F.struct("exported_at", "path")).alias("source_path"),
        F.min("exported_at").cast("date").alias("export_date"),
    )
    return rows.select(
        "file_hash",
        "measurement_type",
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        "source_path",
        "export_date",
        F.current_timestamp().alias("processed_at"),
    )
