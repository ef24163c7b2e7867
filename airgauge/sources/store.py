"""The snapshot store: snapshot folders that never change, and catalog tables that say which count.

Every write of snapshots goes to a folder of its own. The catalog row of a partition names
the folder that holds its rows, and nothing else makes rows visible: a write that breaks
off, or is never cataloged, leaves no trace for readers, and a reader keeps what it started
with. Folders that no kept catalog version names are removed by ``sweep``.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgauge import schema as S
from airgauge.operators.filters import Selection
from airgauge.session import broadcast_if_small, settle
from airgauge.sources.paths import glob_safe

_STORE_KEYS = ("measurement_type", "database_name", "collection_name")
_RUN = "run"  # one write
MEASUREMENTS = "measurements"
ROWS_PER_FILE = 4_000_000
MOST_TASKS = 100_000  # of one write; beyond it a task writes several files

KEPT_VERSIONS = 20  # of a catalog table
ATTEMPTS = 50  # to add a version while others do the same
SWEEP_AFTER = 24 * 3600  # seconds; longer than any write or read takes

# Characters Spark escapes in partition folder names.
_ESCAPED = '%"#\'*/:=?\\{[]^'


def union_kinds(frames: Sequence[DataFrame]) -> DataFrame:
    """Kinds under one set of columns; a column a kind lacks is NULL."""
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union


def write_snapshots(
    rows: DataFrame,
    root: str,
    wanted: DataFrame | None = None,
    rows_per_file: int = ROWS_PER_FILE,
) -> str:
    """Write the partitions found in ``rows`` to a new folder and return its name.

    Nothing that is stored changes, and the rows count only once catalog rows name the
    folder (``snapshot_path``). ``wanted`` holds the ``row_count`` of each partition, and
    may restrict the rows by further columns it shares with them. It is counted when not
    given. A large partition becomes several files, each sorted by time: rows are spread
    over them by a hash of the input split and all cells, so neither a single split nor
    rows at one time meet in one task. Nothing has to be sampled for this.
    """
    keys = list(_STORE_KEYS)
    if wanted is None:
        wanted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    shared = [c for c in wanted.columns if c != "row_count"]
    files = F.ceil(F.col("row_count") / F.lit(rows_per_file)).cast("int")
    sizes = settle(wanted.select(*shared, files.alias("_files")))
    placed = (
        rows.withColumn("_place", F.xxhash64(F.spark_partition_id(), *rows.columns))
        .join(broadcast_if_small(sizes), shared)
        .withColumn("_file", F.pmod("_place", F.col("_files").cast("bigint")))
    )
    # A given number of tasks keeps adaptive execution from merging small ones,
    # which would write all files of a small import one after the other; a large
    # import has about one for each file.
    total = sizes.agg(F.sum("_files")).first()[0] or 1
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(total, MOST_TASKS))
    ordered = placed.repartition(tasks, *keys, "_file").sortWithinPartitions(*keys, "measured_at")
    run = uuid.uuid4().hex
    (
        ordered.select(*[c for c in rows.columns if c not in shared or c in keys])
        .write.option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*keys)
        .parquet(f"{root}/{MEASUREMENTS}/{_RUN}={run}")
    )
    return run


def snapshot_path(run: str) -> Column:
    """Folder of a partition of a write, below the store's root."""

    def escaped(c: Column) -> Column:
        for ch in _ESCAPED:
            c = F.replace(c, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
        return c

    parts = [F.concat(F.lit(f"{k}="), escaped(F.col(k))) for k in _STORE_KEYS]
    return F.concat_ws("/", F.lit(f"{MEASUREMENTS}/{_RUN}={run}"), *parts)


def replace_partitions(
    rows: DataFrame, root: str, exported_at: str, rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Store ``rows`` as the snapshots of the partitions they hold; other partitions stay.

    For rows that do not come from export files. Their content hash is that of no import,
    so a later import of the same partition replaces them; partitions that hold a newer
    export keep it.
    """
    spark = rows.sparkSession
    found = settle(
        rows.groupBy(*_STORE_KEYS).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("measured_at").alias("start_time"),
            F.max("measured_at").alias("end_time"),
        )
    )
    run = write_snapshots(rows, root, found.select(*_STORE_KEYS, "row_count"), rows_per_file)
    time_ = F.lit(exported_at).cast("timestamp_ntz")
    partitions_table(spark, root).upsert(
        found.withColumns(
            {
                "schema_version": F.lit(S.SCHEMA_VERSION),
                "export_date": time_.cast("date"),
                "exported_at": time_,
                "content_hash": F.lit(run),
                "source_file_hash": F.lit(""),
                "parquet_path": snapshot_path(run),
                "processed_at": F.current_timestamp(),
            }
        ),
        newest="exported_at",
    )


def read_snapshots(spark: SparkSession, root: str, where: Column | None = None) -> DataFrame:
    """Stored measurements of the cataloged partitions that ``where`` holds for, by default all.

    Files are found through the catalog: only the folders it names are listed. The driver
    gets one path for each partition read. A cataloged folder that is gone is an error; no
    partitions give an empty result.
    """
    listed = partitions_table(spark, root).read()
    if where is not None:
        listed = listed.where(where)
    paths = sorted(r.parquet_path for r in listed.select("parquet_path").collect())
    struct = S.store_struct()
    if not paths:
        return spark.createDataFrame([], struct)
    # The given schema keeps numeric-looking names text.
    reader = spark.read.schema(T.StructType([*struct.fields, T.StructField(_RUN, T.StringType())]))
    try:
        rows = reader.option("basePath", f"{root}/{MEASUREMENTS}").parquet(
            *[glob_safe(f"{root}/{path}") for path in paths]
        )
    except AnalysisException:
        lost = [path for path in paths if not _Folder(spark, f"{root}/{path}").exists()]
        if not lost:
            raise
        raise FileNotFoundError(f"the store has no files for {len(lost)} partitions: {', '.join(lost[:20])}") from None
    return rows.select(*struct.names)


def read_kind(spark: SparkSession, root: str, kind: str) -> DataFrame:
    rows = read_snapshots(spark, root, F.col("measurement_type") == kind)
    return rows.select(*S.measurement_struct(kind).names)


def read_selection(spark: SparkSession, root: str, selection: Selection) -> DataFrame:
    """Stored rows in the scope of a selection: at most two folders for each collection."""
    return read_snapshots(spark, root, selection.scope())


def exists(spark: SparkSession, path: str) -> bool:
    return _Folder(spark, path).exists()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    _Folder(spark, path).remove()


class _Folder:
    """A folder or file of the file system that Spark finds for its path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._configuration = spark._jsc.hadoopConfiguration()
        self.path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self.path.getFileSystem(self._configuration)

    def exists(self) -> bool:
        return self._files.exists(self.path)

    def full_name(self) -> str:
        return self._files.makeQualified(self.path).toString()

    def entries(self) -> list[tuple[str, int]]:
        """Name and modification time (seconds) of what lies in the folder."""
        if not self.exists():
            return []
        found = self._files.listStatus(self.path)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in found]

    def child(self, name: str) -> bool:
        return self._files.exists(self._jvm.org.apache.hadoop.fs.Path(self.path, name))

    def remove(self) -> None:
        self._files.delete(self.path, True)

    def _context(self):
        contexts = self._jvm.org.apache.hadoop.fs.FileContext
        return contexts.getFileContext(self._files.getUri(), self._configuration)

    def becomes(self, path: str) -> bool:
        """Give the folder the name ``path`` in one step, unless something has it: then False.

        Of several callers one gets the name. That is what the file system's rename
        guarantees where it is atomic, as on a local disk and in HDFS.
        """
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        if self._files.getUri().getScheme() == "file":
            try:
                # Renaming a folder fails where the target is one that holds files.
                os.rename(self.path.toUri().getPath(), target.toUri().getPath())
            except OSError:
                return False
            return True
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context().rename(self.path, target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True


class VersionedTable:
    """A catalog table as a series of complete versions.

    A version is written aside and then takes the next number in one step. Of two writers
    one gets the number; the other starts again from the version that won, so no change is
    lost. A reader never sees a half-written table. Versions older than the last
    ``KEPT_VERSIONS`` are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, struct: T.StructType, key: Sequence[str]):
        self.spark, self.folder, self.struct, self.key = spark, folder, struct, tuple(key)

    def _numbers(self) -> list[int]:
        """Numbers that are taken, by a complete version or by anything else."""
        names = [name for name, _ in _Folder(self.spark, self.folder).entries()]
        return sorted(int(name[1:]) for name in names if name.startswith("v") and name[1:].isdigit())

    def _name(self, number: int) -> str:
        return f"{self.folder}/v{number:08d}"

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        return [n for n in self._numbers() if _Folder(self.spark, self._name(n)).child("_SUCCESS")]

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, by default the last complete one."""
        if number is None:
            numbers = self._numbers()
            while numbers and not _Folder(self.spark, self._name(numbers[-1])).child("_SUCCESS"):
                numbers.pop()
            if not numbers:
                return self.spark.createDataFrame([], self.struct)
            number = numbers[-1]
        return self.spark.read.schema(self.struct).parquet(self._name(number))

    def change(self, update: Callable[[DataFrame], DataFrame]) -> None:
        """Add a version that ``update`` makes from the last one; repeated while others are faster."""
        for attempt in range(ATTEMPTS):
            number = max(self._numbers(), default=0) + 1
            staged = f"{self.folder}/_staged-{uuid.uuid4().hex}"
            rows = update(self.read())
            rows.select(
                *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.struct.fields]
            ).write.parquet(staged)
            if _Folder(self.spark, staged).becomes(self._name(number)):
                for old in self._numbers():
                    if old <= number - KEPT_VERSIONS:
                        _Folder(self.spark, self._name(old)).remove()
                return
            _Folder(self.spark, staged).remove()
            time.sleep(min(0.05 * attempt, 1.0))
        raise RuntimeError(f"{self.folder}: {ATTEMPTS} attempts were overtaken by other writers")

    def write(self, rows: DataFrame) -> None:
        self.change(lambda _: rows)

    def upsert(self, changes: DataFrame, newest: str | None = None) -> None:
        """Insert ``changes`` or replace rows of the same key.

        With ``newest``, the row with the larger value of that column stays, so that two
        writers end with the same rows in either order.
        """
        settled = settle(changes)
        self.change(lambda current: upserted(current, settled, self.key, newest))


def upserted(
    current: DataFrame, changes: DataFrame, key: Sequence[str], newest: str | None = None
) -> DataFrame:
    """``changes`` plus the current rows whose key they do not hold, or which are newer."""
    changes = changes.select(*current.columns)
    if newest is None:
        kept = current.join(changes.select(*key), list(key), "left_anti")
        return kept.unionByName(changes)
    fields = [c for c in current.columns if c not in key]
    both = current.withColumn("_given", F.lit(0)).unionByName(changes.withColumn("_given", F.lit(1)))
    last = both.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(newest, "_given")).alias("_row"))
    return last.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in current.columns])


def sweep(spark: SparkSession, root: str, older_than: float = SWEEP_AFTER) -> list[str]:
    """Remove what no kept version of the partition catalog names; returns the removed folders.

    Writes that broke off, replaced snapshots and catalog versions that were never
    finished go, once nothing was written to them for ``older_than`` seconds. That must be longer
    than a write or a read takes. Snapshot files are listed by Spark; the driver gets the
    folders that go.
    """
    before = time.time() - older_than
    partitions = partitions_table(spark, root)
    named = None
    for number in partitions.versions():
        rows = partitions.read(number).select("parquet_path")
        named = rows if named is None else named.unionByName(rows)
    removed = []
    for table in (partitions, files_table(spark, root), set_aside_table(spark, root)):
        staged = [n for n, at in _Folder(spark, table.folder).entries() if n.startswith("_staged-") and at < before]
        removed += [f"{table.folder.removeprefix(f'{root}/')}/{name}" for name in staged]

    runs = {n for n, at in _Folder(spark, f"{root}/{MEASUREMENTS}").entries() if n.startswith(f"{_RUN}=") and at < before}
    used = set()
    if named is not None:
        run = F.regexp_extract("parquet_path", rf"^{MEASUREMENTS}/({_RUN}=[^/]+)/", 1)
        used = {r.run for r in named.select(run.alias("run")).distinct().collect()}
    unused = sorted(runs - used)
    removed += [f"{MEASUREMENTS}/{name}" for name in unused]
    partly = [glob_safe(f"{root}/{MEASUREMENTS}/{name}") for name in sorted(runs & used)]
    if partly:
        base = _Folder(spark, root).full_name()
        folder = F.regexp_replace(F.substr("path", F.lit(len(base) + 2)), "/[^/]*$", "")
        held = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(partly)
            .groupBy(folder.alias("parquet_path"))
            .agg(F.max(F.unix_timestamp("modificationTime")).alias("at"))
            .where(F.col("at") < before)
        )
        removed += sorted(r.parquet_path for r in held.join(named, "parquet_path", "left_anti").collect())
    for name in removed:
        _Folder(spark, f"{root}/{name}").remove()
    return removed


def partitions_table(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(
        spark, f"{root}/catalog/measurement_partitions", S.PARTITIONS_STRUCT, S.PARTITION_KEY
    )


def files_table(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(
        spark,
        f"{root}/catalog/processed_files",
        S.FILES_STRUCT,
        ("file_hash", "measurement_type", "schema_version"),
    )


def set_aside_table(spark: SparkSession, root: str) -> VersionedTable:
    """Files that could not be imported, and why."""
    return VersionedTable(spark, f"{root}/catalog/set_aside_files", S.SET_ASIDE_STRUCT, ("path",))


def migrated(partitions: DataFrame) -> DataFrame:
    """A partition catalog of any earlier form with all current columns.

    Rows from before versioning are version 1; an export known only by date was
    made at its midnight.
    """
    defaults = {
        "schema_version": F.lit(1),
        "exported_at": F.lit(None).cast("timestamp_ntz"),
        "source_file_hash": F.lit(""),
        "processed_at": F.lit(None).cast("timestamp"),
    }
    added = partitions.withColumns(
        {name: value for name, value in defaults.items() if name not in partitions.columns}
    )
    filled = added.withColumn(
        "exported_at", F.coalesce("exported_at", F.col("export_date").cast("timestamp_ntz"))
    )
    return filled.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.PARTITIONS_STRUCT.fields]
    )
