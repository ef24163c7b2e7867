"""Queries over the partition catalog and the canonical-measurement keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.functions import labels as L
from airgauge.operators.filters import Selection
from airgauge.session import broadcast_if_small, settle

COLLECTION = ("database_name", "collection_name")


def collections_view(partitions: DataFrame) -> DataFrame:
    """Time range, latest export and technologies of each collection."""
    kind = F.col("measurement_type")
    return partitions.groupBy(*COLLECTION).agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.max("export_date").alias("latest_export_date"),
        F.bool_or(kind.like("lte_%")).alias("has_lte"),
        F.bool_or(kind.like("nr_%")).alias("has_nr"),
    )


def database_rows(partitions: DataFrame, database: str | None = None) -> DataFrame:
    if database:
        partitions = partitions.where(F.col("database_name") == database)
    return partitions.groupBy("database_name").agg(
        F.count_distinct("collection_name").alias("collections"),
        F.max("export_date").alias("latest_export_date"),
    )


def collection_rows(partitions: DataFrame, database: str | None = None) -> DataFrame:
    if database:
        partitions = partitions.where(F.col("database_name") == database)
    kind = F.col("measurement_type")
    return partitions.groupBy(*COLLECTION).agg(
        F.count_if(kind.like("lte_%")).alias("lte_partitions"),
        F.count_if(kind.like("nr_%")).alias("nr_partitions"),
        F.sort_array(F.collect_list(kind)).alias("measurement_types"),
    )


def summary_report(partitions: DataFrame, database: str | None = None) -> DataFrame:
    """Report rows: each collection with its technologies under its database totals."""
    databases = database_rows(partitions, database).select(
        "database_name",
        F.concat(L.grouped(F.col("collections")), F.lit(" collections")).alias("size"),
        L.or_dash(F.date_format("latest_export_date", "yyyy-MM-dd")).alias("latest_export"),
    )
    collections = collection_rows(partitions, database).select(
        *COLLECTION,
        L.technology_counts(F.col("lte_partitions"), F.col("nr_partitions")).alias("technologies"),
        F.array_join("measurement_types", ", ").alias("types"),
    )
    return collections.join(databases, "database_name")


def _of_kind(place: int) -> Column:
    """Category (0) or technology (1) of the row's kind; null for an unknown one."""
    pairs = [F.lit(x) for kind, parts in S.KINDS.items() for x in (kind, parts[place])]
    return F.try_element_at(F.create_map(*pairs), F.col("measurement_type"))


def collection_entries(partitions: DataFrame) -> DataFrame:
    """Collections with time range and the categories and technologies they have."""
    order = F.array(*[F.lit(c) for c in S.CATEGORIES])
    return partitions.groupBy(*COLLECTION).agg(
        F.min("start_time").alias("start"),
        F.max("end_time").alias("end"),
        F.array_intersect(order, F.collect_set(_of_kind(0))).alias("categories"),
        F.sort_array(F.collect_set(_of_kind(1))).alias("technologies"),
    )


def catalog_tree(partitions: DataFrame) -> DataFrame:
    """Databases with their collections nested in name order.

    The catalog has one row for each partition; measurements are not touched.
    """
    entry = F.struct(
        F.col("collection_name").alias("name"), "start", "end", "categories", "technologies"
    )
    return (
        collection_entries(partitions)
        .groupBy(F.col("database_name").alias("name"))
        .agg(F.sort_array(F.collect_list(entry)).alias("collections"))
    )


def selection_range(collections: DataFrame) -> DataFrame:
    return collections.agg(F.min("start").alias("start"), F.max("end").alias("end"))


def selection_categories(collections: DataFrame) -> DataFrame:
    """Categories that any of the collections has, in menu order."""
    order = F.array(*[F.lit(c) for c in S.CATEGORIES])
    found = collections.select(F.explode("categories").alias("value")).distinct()
    return found.select(
        F.array_position(order, F.col("value")).cast("int").alias("place"), "value"
    )


def key_filter(measurements: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose partition is listed in ``keys``.

    The keys are written down first, so that their plan runs once. Keys of a checked size
    are broadcast, so that only listed partitions are read. The condition on them holds
    for every key; Spark prunes by the keys of a join only where these are filtered.
    """
    listed = settle(keys.select(*S.PARTITION_KEY).distinct())
    filtered = listed.where(F.length("measurement_type") >= 0)
    return measurements.join(broadcast_if_small(filtered), list(S.PARTITION_KEY), "left_semi")


def catalog_keys(partitions: DataFrame, selection: Selection) -> DataFrame:
    return partitions.where(selection.scope())


def natural_order(names: DataFrame, column: str) -> DataFrame:
    return names.withColumn("sort_key", L.natural_key(F.col(column)))


def iso(c: Column) -> Column:
    """ISO-8601 text of a zone-free timestamp, fraction only when there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))
