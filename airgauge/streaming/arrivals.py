"""Incremental import of exports as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from airgauge.plans.ingest import ingest, retry_set_aside


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Paths of new files below ``folder``; their contents are not read here."""
    struct = "path string, modificationTime timestamp, length bigint, content binary"
    return (
        spark.readStream.format("binaryFile")
        .schema(struct)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")
    )


def follow(
    spark: SparkSession, folder: str, root: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Import everything that has arrived, then stop.

    The checkpoint remembers files that were handed on; an import that is
    repeated after a failure finds its files processed or writes the same
    snapshots again. An export that arrives late loses to a newer one already
    stored, so no watermark is needed. A file that cannot be imported is set aside
    with the reason (``store.set_aside_table``) and holds up no other; once it was
    changed, the next run takes it again.
    """
    retry_set_aside(spark, root)

    def import_batch(batch: DataFrame, _: int) -> None:
        paths = [row.path for row in batch.collect()]  # at most files_per_batch
        if paths:
            ingest(spark, paths, root, set_aside=True)

    return (
        arriving_files(spark, folder, files_per_batch)
        .writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
