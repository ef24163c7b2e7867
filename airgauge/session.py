"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ARCHIVE = "airgauge-package.zip"


def build_session(app: str = "airgauge", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the library is written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        # Checkpoint files go once nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the Python line of every expression doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a
    missing setting is an error, because a machine-local path would lose data
    with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="airgauge-")
    context.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, rows: int = 200_000, size: int = 64 << 20) -> DataFrame:
    """Mark ``df`` for broadcast when its rows and their length as text show that it is small.

    Beyond either limit the join is left to shuffles, where adaptive execution splits
    skewed keys. ``df`` is computed for this, so a long plan should be settled before.
    """
    length = F.sum(F.length(F.to_json(F.struct(*df.columns))))
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(length, F.lit(0)).alias("size")).first()
    return F.broadcast(df) if seen.rows <= rows and seen.size <= size else df


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give all Python workers this package, wherever they run; once for each context.

    Spark hands the archive out from the driver, so nothing needs to be installed on
    the executors and the working folder does not matter.
    """
    context = spark.sparkContext
    if any(os.path.basename(path) == _ARCHIVE for path in context._python_includes):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="airgauge-"), _ARCHIVE)
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
