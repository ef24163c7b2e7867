"""Partition catalog, fingerprints and export bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.functions import names
from airgauge.operators import catalog, fingerprint
from airgauge.operators.filters import Selection
from airgauge.plans import ingest, payloads
from airgauge.plans.staging import staging
from airgauge.session import fresh_folder, settle
from airgauge.sources import exports, store
from workloads.fixtures import partitions, view
from workloads.ingested import move
from workloads.registry import query
from workloads.summaries import COLLECTIONS, by_key, count_by_key, read_back


@query(
    "collections_view",
    """SELECT database_name, collection_name, min(start_time) AS start_time, max(end_time) AS end_time,
  max(export_date) AS latest_export_date, bool_or(measurement_type LIKE 'lte_%') AS has_lte,
  bool_or(measurement_type LIKE 'nr_%') AS has_nr FROM p GROUP BY database_name, collection_name""",
    views=("p",),
)
def collections_view(spark, folder):
    return catalog.collections_view(partitions(spark, folder))


@query(
    "catalog_databases",
    """SELECT database_name, count(DISTINCT collection_name) AS collections,
  max(export_date) AS latest_export_date FROM p GROUP BY database_name""",
    views=("p",),
)
def catalog_databases(spark, folder):
    return catalog.database_rows(partitions(spark, folder))


@query(
    "catalog_collections",
    """SELECT database_name, collection_name, count(*) FILTER (WHERE measurement_type LIKE 'lte_%') AS lte_partitions,
  count(*) FILTER (WHERE measurement_type LIKE 'nr_%') AS nr_partitions,
  array_to_string(list_sort(list(measurement_type)), ',') AS measurement_types
  FROM p WHERE database_name = 'db_b' GROUP BY database_name, collection_name""",
    views=("p",),
)
def catalog_collections(spark, folder):
    rows = catalog.collection_rows(partitions(spark, folder), "db_b")
    return rows.withColumn("measurement_types", F.array_join("measurement_types", ","))


@query(
    "catalog_summary",
    """SELECT database_name, collection_name,
  concat('LTE(#', count(*) FILTER (WHERE measurement_type LIKE 'lte_%'), ')+NR(#',
    count(*) FILTER (WHERE measurement_type LIKE 'nr_%'), ')') AS technologies,
  string_agg(measurement_type, ', ' ORDER BY measurement_type) AS types,
  concat(any_value(n), ' collections') AS size, strftime(any_value(latest), '%Y-%m-%d') AS latest_export
  FROM p JOIN (SELECT database_name, count(DISTINCT collection_name) AS n, max(export_date) AS latest
    FROM p GROUP BY database_name) USING (database_name) GROUP BY database_name, collection_name""",
    views=("p",),
)
def catalog_summary(spark, folder):
    return catalog.summary_report(partitions(spark, folder))


ENTRIES_SQL = """SELECT database_name, collection_name, min(start_time) AS s, max(end_time) AS e,
  list(DISTINCT replace(regexp_replace(measurement_type, '^(lte|nr)_', ''), 'radio_neighbor', 'neighbor')) AS found,
  array_to_string(list_sort(list(DISTINCT upper(split_part(measurement_type, '_', 1)))), '+') AS technologies
  FROM p GROUP BY database_name, collection_name"""


@query(
    "catalog_tree",
    f"""SELECT database_name AS name, collection_name AS collection, s AS start, e AS "end",
  array_to_string(list_filter(['radio', 'neighbor', 'pdsch', 'pusch'], lambda c: list_contains(found, c)), '+') AS categories,
  technologies FROM ({ENTRIES_SQL})""",
    views=("p",),
)
def catalog_tree(spark, folder):
    tree = catalog.catalog_tree(partitions(spark, folder))
    rows = tree.select("name", F.explode("collections").alias("c"))
    return rows.select(
        "name",
        F.col("c.name").alias("collection"),
        "c.start",
        "c.end",
        F.array_join("c.categories", "+").alias("categories"),
        F.array_join("c.technologies", "+").alias("technologies"),
    )


@query(
    "json_catalog",
    f"""SELECT database_name AS name, collection_name AS collection, s AS start, e AS "end",
  array_to_string(list_filter(['radio', 'neighbor', 'pdsch', 'pusch'], lambda c: list_contains(found, c)), '+') AS categories,
  technologies, CAST({len(S.METRIC_ROWS)} AS BIGINT) AS metrics FROM ({ENTRIES_SQL})""",
    views=("p",),
)
def json_catalog(spark, folder):
    """The whole catalog as one JSON record."""
    record = read_back(payloads.catalog_payload(partitions(spark, folder)))
    metrics = F.aggregate("measurements", F.lit(0).cast("bigint"), lambda n, m: n + F.size(m["metrics"]))
    databases = record.select(F.explode("databases").alias("d"), metrics.alias("metrics"))
    rows = databases.select(F.col("d.name").alias("name"), F.explode("d.collections").alias("c"), "metrics")
    return rows.select(
        "name",
        F.col("c.name").alias("collection"),
        F.col("c.start").cast("timestamp_ntz").alias("start"),
        F.col("c.end").cast("timestamp_ntz").alias("end"),
        F.array_join("c.categories", "+").alias("categories"),
        F.array_join("c.technologies", "+").alias("technologies"),
        "metrics",
    )


@query(
    "selection_range",
    """SELECT min(start_time) AS start, max(end_time) AS "end" FROM p
  WHERE database_name = 'db_a' AND collection_name IN ('col_1', 'col_2')""",
    views=("p",),
)
def selection_range(spark, folder):
    entries = catalog.collection_entries(partitions(spark, folder))
    chosen = entries.where(
        (F.col("database_name") == "db_a") & F.col("collection_name").isin("col_1", "col_2")
    )
    return catalog.selection_range(chosen)


@query(
    "selection_categories",
    """SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS place, value FROM (
  SELECT DISTINCT replace(regexp_replace(measurement_type, '^(lte|nr)_', ''), 'radio_neighbor', 'neighbor') AS value FROM p)
  JOIN (VALUES (1, 'radio'), (2, 'neighbor'), (3, 'pdsch'), (4, 'pusch')) AS t(place, value) USING (value)""",
    views=("p",),
)
def selection_categories(spark, folder):
    return catalog.selection_categories(catalog.collection_entries(partitions(spark, folder)))


@query(
    "catalog_semi_join",
    by_key("""database_name = 'db_a' AND collection_name IN ('col_0', 'col_1', 'col_2', 'col_3', 'col_4')
  AND measurement_type IN ('lte_pdsch', 'nr_pdsch')"""),
)
def catalog_semi_join(spark, folder):
    selection = Selection.of(
        {"database": "db_a", "collections": COLLECTIONS, "measurement": "pdsch"}
    )
    keys = catalog.catalog_keys(partitions(spark, folder), selection)
    return count_by_key(catalog.key_filter(view(spark, folder, "m"), keys))


PREFIXES = ("RUN ", "rün ", "Run ", "zébra ", "Äpfel", "apfel", "Zebra ")
PREFIX_SQL = "CASE pci % 7 " + " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(PREFIXES)) + " END"


@query(
    "natural_sort",
    f"""SELECT model, name, CAST(row_number() OVER (PARTITION BY model ORDER BY strip_accents(lower(prefix)), pci) AS INTEGER) AS place
  FROM (SELECT DISTINCT model, pci, {PREFIX_SQL} AS prefix, concat({PREFIX_SQL}, pci, 'b') AS name FROM m)""",
)
def natural_sort(spark, folder):
    """Names of either case and with accents, ordered by their letters and numbers."""
    found = (
        view(spark, folder, "m")
        .select("model", F.concat(F.expr(PREFIX_SQL), F.col("pci").cast("string"), F.lit("b")).alias("name"))
        .distinct()
    )
    keyed = catalog.natural_order(found, "name")
    place = F.row_number().over(Window.partitionBy("model").orderBy("sort_key", "name"))
    return keyed.select("model", "name", place.alias("place"))


@query(
    "partition_summary",
    """SELECT database_name, collection_name, measurement_type, count(*) AS row_count,
  min(measured_at) AS start_time, max(measured_at) AS end_time FROM m
  GROUP BY database_name, collection_name, measurement_type""",
)
def partition_summary(spark, folder):
    rows = view(spark, folder, "m")
    text = fingerprint.row_text(["event_id", "measured_at"])
    return fingerprint.partition_summaries(rows, S.PARTITION_KEY, text).select(
        *S.PARTITION_KEY, "row_count", "start_time", "end_time"
    )


HASHED = ["event_id", "measured_at", "pci", "band_number"]


def row_json(time: str) -> str:
    """SQL of the text that stands for a row in a fingerprint."""
    fields = f"""'{{"event_id":', event_id, ',"measured_at":"', strftime({time}, '%Y-%m-%dT%H:%M:%S.%f'), '","pci":', pci"""
    return f"""concat({fields}, ',"band_number":', coalesce(CAST(band_number AS VARCHAR), 'null'), '}}')"""


_SUMS = ("row_count", "start_time", "end_time", "lower_sum", "lower_xor", "upper_sum", "upper_xor")


@query(
    "content_hash",
    f"""SELECT *, sha256(concat_ws('|', '2.2', measurement_type, 'event_id,measured_at,pci,band_number', {", ".join(
      f"CAST({c} AS VARCHAR)" for c in _SUMS)})) AS content_hash FROM (
  SELECT database_name, collection_name, measurement_type, count(*) AS row_count,
    min(measured_at) AS start_time, max(measured_at) AS end_time,
    CAST(sum(a) AS VARCHAR) AS lower_sum, CAST(bit_xor(a) AS VARCHAR) AS lower_xor,
    CAST(sum(b) AS VARCHAR) AS upper_sum, CAST(bit_xor(b) AS VARCHAR) AS upper_xor
  FROM (SELECT *, CAST(concat('0x', substr(h, 1, 15)) AS BIGINT) AS a, CAST(concat('0x', substr(h, 16, 15)) AS BIGINT) AS b
    FROM (SELECT *, md5({row_json('measured_at')}) AS h FROM m))
  GROUP BY database_name, collection_name, measurement_type)""",
)
def content_hash(spark, folder):
    summaries = fingerprint.partition_summaries(
        view(spark, folder, "m"), S.PARTITION_KEY, fingerprint.row_text(HASHED)
    )
    hashed = summaries.withColumn(
        "content_hash", fingerprint.fingerprint(F.col("measurement_type"), F.lit(",".join(HASHED)))
    )
    return hashed.withColumns({c: F.col(c).cast("string") for c in _SUMS[3:]})


@query(
    "fingerprint_microseconds",
    f"""SELECT database_name, collection_name, measurement_type, CASE WHEN bool_or(event_id % 64 = 0) THEN 'REPLACE'
  ELSE 'SKIP unchanged' END AS action FROM m GROUP BY database_name, collection_name, measurement_type""",
)
def fingerprint_microseconds(spark, folder):
    """A newer export in which some times differ by one microsecond, against the stored one."""
    rows = view(spark, folder, "m")
    later = F.when(F.col("event_id") % 64 == 0, F.col("measured_at") + F.expr("INTERVAL '0.000001' SECOND"))
    moved = rows.withColumn("measured_at", F.coalesce(later, "measured_at"))

    def snapshot(frame, exported_at):
        summaries = fingerprint.partition_summaries(frame, S.PARTITION_KEY, fingerprint.row_text(HASHED))
        # The span of times would tell most changes by itself.
        spanless = summaries.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("start_time", "end_time")})
        mark = fingerprint.fingerprint(F.col("measurement_type"), F.lit(",".join(HASHED)))
        return spanless.select(
            *S.PARTITION_KEY,
            mark.alias("content_hash"),
            F.lit(exported_at).cast("timestamp_ntz").alias("exported_at"),
            F.lit(S.SCHEMA_VERSION).alias("schema_version"),
        )

    plan = ingest.snapshot_actions(snapshot(moved, "2026-06-12"), snapshot(rows, "2026-06-10"))
    return plan.select(*S.PARTITION_KEY, "action")


@query(
    "content_hash_of_all_columns",
    """SELECT measurement_type, CAST(count(*) AS BIGINT) AS partitions, TRUE AS same FROM (
  SELECT DISTINCT database_name, collection_name, measurement_type FROM m) GROUP BY measurement_type""",
)
def content_hash_of_all_columns(spark, folder):
    """Row order does not change a fingerprint over whole rows."""
    rows = view(spark, folder, "m")
    columns = rows.columns

    def hashes(frame, name):
        summaries = fingerprint.partition_summaries(
            frame, S.PARTITION_KEY, fingerprint.row_text(columns)
        )
        value = fingerprint.fingerprint(F.col("measurement_type"), F.lit(",".join(columns)))
        return summaries.select(*S.PARTITION_KEY, value.alias(name))

    mixed = hashes(rows.repartition(5, "event_id"), "mixed")
    both = hashes(rows, "plain").join(mixed, list(S.PARTITION_KEY))
    return both.groupBy("measurement_type").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.bool_and(F.col("plain") == F.col("mixed")).alias("same"),
    )


STEM_SQL = r"lower(regexp_extract(path, '([^/]+)\.[^./]*$', 1))"
KIND_SQL = f"CASE {STEM_SQL} WHEN 'lte_radio' THEN 'lte_radio' WHEN 'nr_pusch' THEN 'nr_pusch' END"
FOLDER_SQL = "regexp_extract(path, '([^/]+)/[^/]+$', 1)"
TIME_SQL = "coalesce(try_strptime({f}, '%Y%m%d-%H%M'), try_strptime({f}, '%Y%m%d'))"
FOUND_SQL = f"""SELECT *, {FOLDER_SQL} AS folder, {KIND_SQL} AS kind,
    {TIME_SQL.format(f=FOLDER_SQL)} AS exported_at, split_part(path, '/', 3) AS database_name
  FROM exports WHERE lower(path) LIKE '%.csv' AND path NOT LIKE '%/_temp/%' ESCAPE '!' AND {KIND_SQL} IS NOT NULL""".replace(
    "'%/_temp/%' ESCAPE '!'", "'%/!_temp/%' ESCAPE '!'"
)


def found(spark, folder):
    rows = exports.discover(view(spark, folder, "exports"))
    return rows.withColumn("database_name", F.split("path", "/")[2])


@query(
    "source_discovery",
    f"SELECT delivery_id, path, kind, folder, exported_at FROM ({FOUND_SQL})",
    views=("exports",),
)
def source_discovery(spark, folder):
    return found(spark, folder).select("delivery_id", "path", "kind", "folder", "exported_at")


ODD_FOLDER_SQL = """concat('2026', lpad(CAST(delivery_id % 15 AS VARCHAR), 2, '0'), lpad(CAST(delivery_id % 33 AS VARCHAR), 2, '0'),
  CASE WHEN delivery_id % 4 = 0 THEN concat('-', lpad(CAST(delivery_id % 27 AS VARCHAR), 2, '0'), '15') ELSE '' END)"""


@query(
    "export_time",
    f"""SELECT delivery_id, exported_at, odd, odd_time, odd_time IS NOT NULL AS valid FROM (
  SELECT delivery_id, {TIME_SQL.format(f=FOLDER_SQL)} AS exported_at, {ODD_FOLDER_SQL} AS odd,
    {TIME_SQL.format(f=ODD_FOLDER_SQL)} AS odd_time FROM exports)""",
    views=("exports",),
)
def export_time(spark, folder):
    def padded(divisor):
        return F.lpad((F.col("delivery_id") % divisor).cast("string"), 2, "0")

    clock = F.when(F.col("delivery_id") % 4 == 0, F.concat(F.lit("-"), padded(27), F.lit("15")))
    odd = F.concat(F.lit("2026"), padded(15), padded(33), F.coalesce(clock, F.lit("")))
    return view(spark, folder, "exports").select(
        "delivery_id",
        names.folder_time(names.export_folder(F.col("path"))).alias("exported_at"),
        odd.alias("odd"),
        names.folder_time(odd).alias("odd_time"),
        names.is_export_date(odd).alias("valid"),
    )


@query(
    "file_alias",
    f"""SELECT delivery_id, stem, replace(stem, '_neig', '_neighbor') AS kind FROM (
  SELECT delivery_id, CASE {STEM_SQL} WHEN 'lte_radio' THEN 'lte_radio' WHEN 'lte radio neig' THEN 'lte_radio_neig'
    WHEN 'nr pdsch [per-carrier]' THEN 'nr_pdsch' WHEN 'nr_pusch' THEN 'nr_pusch'
    WHEN 'nr radio beam' THEN 'nr_radio_neig' END AS stem FROM exports)""",
    views=("exports",),
)
def file_alias(spark, folder):
    stem = names.archive_stem(F.col("path"))
    return view(spark, folder, "exports").select(
        "delivery_id", stem.alias("stem"), names.stem_kind(stem).alias("kind")
    )


def text_files(spark, lines, heads, label):
    """Lines (home, place, line) as one text file for each home, headed by ``heads`` (home, line)."""
    target = fresh_folder(spark, label)
    every = lines.unionByName(heads.select("home", F.lit(-1).cast("bigint").alias("place"), "line"))
    ordered = every.repartition(8, "home").sortWithinPartitions("home", "place")
    ordered.select("home", "line").write.partitionBy("home").text(target)
    return target


@query(
    "first_database",
    """SELECT concat('t', regexp_replace(time_text, '[^0-9]', '', 'g')) AS home,
  arg_min(trim(collection_text), event_id) FILTER (WHERE trim(collection_text) <> '') AS value FROM raw GROUP BY time_text""",
    views=("raw",),
)
def first_database(spark, folder):
    """Export files of each time, opened to find the first value of their Database column."""
    home = F.concat(F.lit("t"), F.regexp_replace("time_text", "[^0-9]", "")).alias("home")
    rows = view(spark, folder, "raw")
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.coalesce("collection_text", F.lit("")), "time_text")
    heads = rows.select(home).distinct().withColumn("line", F.lit("Event,data BASE,Time"))
    target = text_files(spark, rows.select(home, F.col("event_id").alias("place"), line.alias("line")), heads, "dropped")
    files = exports.contents(spark, [target])
    found = exports.first_databases(spark, files)
    return found.select(F.regexp_extract("path", "home=([^/]+)/", 1).alias("home"), "value")


# Vendor names of dropped files, by kind; the last is no known name.
DROPPED = {
    "lte_radio": "LTE Radio Connected", "lte_radio_neighbor": "LTE Radio Neig", "lte_pdsch": "LTE PDSCH [per carrier]",
    "lte_pusch": "lte_pusch", "nr_radio": "nr_radio", "nr_radio_neighbor": "NR Radio Beam", "nr_pdsch": "NR PDSCH (Per-Carrier)",
    "nr_pusch": "notes",
}
STAGED_SQL = """SELECT measurement_type AS kind, arg_min(nullif(trim(base), ''), event_id) FILTER (WHERE trim(base) <> '') AS base,
    sha256(concat('Event,Database', chr(10), string_agg(concat(event_id, ',', base, chr(10)), '' ORDER BY event_id))) AS file_hash
  FROM (SELECT *, CASE WHEN measurement_type = 'nr_radio' THEN ' ' WHEN event_id % 3 = 0 THEN '' ELSE concat(' ', database_name) END AS base FROM m)
  GROUP BY measurement_type"""


@query(
    "staging_files",
    f"""SELECT kind, CASE WHEN kind = 'nr_pusch' OR base IS NULL THEN NULL ELSE concat(base, '/20260612/',
    replace(kind, 'neighbor', 'neig'), '.csv') END AS target, file_hash,
  CASE WHEN kind = 'nr_pusch' THEN 'unknown file name' WHEN base IS NULL THEN 'no Database value' END AS problem,
  CASE WHEN kind = 'nr_pusch' OR base IS NULL THEN 'ERROR' WHEN kind = 'lte_radio' THEN 'SKIP'
    WHEN kind = 'lte_pdsch' THEN 'CONFLICT' ELSE 'STAGE' END AS action FROM ({STAGED_SQL})""",
)
def staging_files(spark, folder):
    """A drop folder of one file a kind against an archive that has two of them, one changed."""
    base = F.expr(
        "CASE WHEN measurement_type = 'nr_radio' THEN ' ' WHEN event_id % 3 = 0 THEN '' ELSE concat(' ', database_name) END"
    )
    rows = view(spark, folder, "m").select(
        F.col("measurement_type").alias("home"), F.col("event_id").alias("place"),
        F.concat_ws(",", F.col("event_id").cast("string"), base).alias("line"),
    )
    heads = rows.select("home").distinct().withColumn("line", F.lit("Event,Database"))
    drop, archive = fresh_folder(spark, "drop"), fresh_folder(spark, "archived")
    for copy, kinds in ((archive, ("lte_radio", "lte_pdsch")), (drop, tuple(DROPPED))):
        held = rows.where(F.col("home").isin(*kinds))
        if copy == archive:
            held = held.withColumn("line", F.when(F.col("home") == "lte_pdsch", F.reverse("line")).otherwise(F.col("line")))
            # The database of a file is that of its first row that has one.
            first = view(spark, folder, "m").where("event_id % 3 <> 0").groupBy("measurement_type").agg(
                F.min_by("database_name", "event_id").alias("base")
            )
            bases = {r.measurement_type: r.base for r in first.collect()}
        staged = text_files(spark, held, heads.where(F.col("home").isin(*kinds)), "files")
        for row in exports.list_files(spark, [staged]).collect():
            kind = row.path.split("home=")[1].split("/")[0]
            if copy == archive:
                move(spark, row.path, f"{archive}/{bases[kind]}/20260612", f"{kind}.csv")
            else:
                move(spark, row.path, drop, f"{DROPPED[kind]}.csv")
    names_ = {f"{name}.csv": kind for kind, name in DROPPED.items()}
    found = staging(spark, drop, archive, "20260612")
    kind = names.lookup(names.file_name(F.col("path")), names_)
    return found.select(kind.alias("kind"), "target", "file_hash", "problem", "action")


@query(
    "unprocessed_files",
    f"""SELECT delivery_id, file_hash, kind FROM ({FOUND_SQL}) f WHERE NOT EXISTS (
  SELECT 1 FROM ({FOUND_SQL}) d WHERE d.folder < '20260613' AND d.file_hash = f.file_hash AND d.kind = f.kind)""",
    views=("exports",),
)
def unprocessed_files(spark, folder):
    files = found(spark, folder)
    processed = files.where(F.col("folder") < "20260613").select(
        "file_hash",
        F.col("kind").alias("measurement_type"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
    )
    return exports.unprocessed(files, processed).select("delivery_id", "file_hash", "kind")


KEYED_SQL = f"""SELECT database_name, collection_name, kind AS measurement_type, exported_at, file_hash,
  concat(path, '#', delivery_id) AS path FROM ({FOUND_SQL})"""
LATEST_SQL = """SELECT * FROM ({source}) QUALIFY row_number() OVER (
  PARTITION BY database_name, collection_name, measurement_type ORDER BY exported_at DESC, path) = 1"""


def deliveries(spark, folder):
    return found(spark, folder).select(
        "database_name",
        "collection_name",
        F.col("kind").alias("measurement_type"),
        "exported_at",
        "file_hash",
        F.concat("path", F.lit("#"), F.col("delivery_id").cast("string")).alias("path"),
    )


@query("latest_snapshot", LATEST_SQL.format(source=KEYED_SQL), views=("exports",))
def latest_snapshot(spark, folder):
    return ingest.latest_snapshots(deliveries(spark, folder))


NEW_SQL = LATEST_SQL.format(source=f"SELECT * FROM ({KEYED_SQL}) WHERE right(path, 1) IN ('0', '1', '2', '4', '5', '7')")
OLD_SQL = LATEST_SQL.format(source=f"SELECT * FROM ({KEYED_SQL}) WHERE right(path, 1) IN ('1', '3', '6', '8', '9') AND collection_name <> 'col_3'")


def old_and_new(spark, folder):
    """Two deliveries that share some files, as catalog rows and incoming snapshots."""
    all_ = deliveries(spark, folder).withColumnRenamed("file_hash", "content_hash")
    last = F.right("path", F.lit(1))
    new = ingest.latest_snapshots(all_.where(last.isin("0", "1", "2", "4", "5", "7")))
    old = ingest.latest_snapshots(
        all_.where(last.isin("1", "3", "6", "8", "9") & (F.col("collection_name") != "col_3"))
    ).withColumn("schema_version", F.lit(S.SCHEMA_VERSION))
    return old, new


@query(
    "snapshot_plan",
    f"""SELECT n.database_name, n.collection_name, n.measurement_type, n.path, CASE WHEN o.path IS NULL THEN 'ADD'
  WHEN n.exported_at < o.exported_at THEN 'SKIP older' WHEN n.file_hash = o.file_hash THEN 'SKIP unchanged'
  ELSE 'REPLACE' END AS action
  FROM ({NEW_SQL}) n LEFT JOIN ({OLD_SQL}) o USING (database_name, collection_name, measurement_type)""",
    views=("exports",),
)
def snapshot_plan(spark, folder):
    old, new = old_and_new(spark, folder)
    return ingest.snapshot_actions(new, old).select(*S.PARTITION_KEY, "path", "action")


@query(
    "staging_plan",
    f"""SELECT path, CASE WHEN hash IS NULL THEN CASE WHEN place = 1 THEN 'STAGE' WHEN file_hash = first_hash THEN 'SKIP'
    ELSE 'CONFLICT' END WHEN hash = file_hash THEN 'SKIP' ELSE 'CONFLICT' END AS action FROM (
  SELECT n.path, n.file_hash, o.file_hash AS hash, row_number() OVER w AS place, first_value(n.file_hash) OVER w AS first_hash
  FROM (SELECT * FROM ({KEYED_SQL}) WHERE right(path, 1) IN ('0', '1', '2', '4', '5', '7')) n
  LEFT JOIN ({OLD_SQL}) o USING (database_name, collection_name, measurement_type)
  WINDOW w AS (PARTITION BY database_name, collection_name, measurement_type ORDER BY n.path))""",
    views=("exports",),
)
def staging_plan(spark, folder):
    """Many dropped files for one target, against one archived file at most."""

    def targets(frame):
        key = F.concat_ws("/", *S.PARTITION_KEY)
        return frame.select(key.alias("target"), "path", "file_hash")

    old, _ = old_and_new(spark, folder)
    dropped = deliveries(spark, folder).where(F.right("path", F.lit(1)).isin("0", "1", "2", "4", "5", "7"))
    archived = targets(old.withColumnRenamed("content_hash", "file_hash"))
    return exports.staging_plan(targets(dropped), archived).select("path", "action")


@query(
    "catalog_upsert",
    f"""SELECT database_name, collection_name, measurement_type, exported_at, content_hash FROM (
  SELECT database_name, collection_name, measurement_type, exported_at, file_hash AS content_hash FROM ({NEW_SQL})
  UNION ALL SELECT database_name, collection_name, measurement_type, exported_at, file_hash FROM ({OLD_SQL}) o
  WHERE NOT EXISTS (SELECT 1 FROM ({NEW_SQL}) n WHERE n.database_name = o.database_name
    AND n.collection_name = o.collection_name AND n.measurement_type = o.measurement_type))""",
    views=("exports",),
)
def catalog_upsert(spark, folder):
    """Two versions of the partition catalog, written and read back."""
    table = store.partitions_table(spark, fresh_folder(spark, "catalog"))
    for rows in old_and_new(spark, folder):
        table.upsert(
            rows.select(
                *S.PARTITION_KEY,
                F.lit(S.SCHEMA_VERSION).alias("schema_version"),
                F.col("exported_at").cast("date").alias("export_date"),
                "exported_at",
                F.lit(0).alias("row_count"),
                F.lit(None).alias("start_time"),
                F.lit(None).alias("end_time"),
                "content_hash",
                F.lit("").alias("source_file_hash"),
                F.col("path").alias("parquet_path"),
                F.current_timestamp().alias("processed_at"),
            )
        )
    return table.read().select(*S.PARTITION_KEY, "exported_at", "content_hash")


@query(
    "processed_upsert",
    f"""SELECT file_hash, measurement_type, max(path) AS source_path FROM ({KEYED_SQL}) GROUP BY file_hash, measurement_type""",
    views=("exports",),
)
def processed_upsert(spark, folder):
    """File rows of three waves; a later wave replaces rows with the same key."""
    table = store.files_table(spark, fresh_folder(spark, "files"))
    rows = deliveries(spark, folder)
    best = rows.groupBy("file_hash", "measurement_type").agg(
        F.min("path").alias("lowest"), F.max("path").alias("highest")
    )
    for column in ("lowest", "highest"):
        table.upsert(
            best.select(
                "file_hash",
                "measurement_type",
                F.lit(S.SCHEMA_VERSION).alias("schema_version"),
                F.col(column).alias("source_path"),
                F.lit("2026-06-10").cast("date").alias("export_date"),
                F.current_timestamp().alias("processed_at"),
            )
        )
    return table.read().select("file_hash", "measurement_type", "source_path")


@query(
    "catalog_race",
    f"""SELECT file_hash, measurement_type, CASE WHEN file_hash < 'a' THEN min(path) ELSE max(path) END AS source_path
  FROM ({KEYED_SQL}) GROUP BY file_hash, measurement_type""",
    views=("exports",),
)
def catalog_race(spark, folder):
    """A second writer adds its version while the first one still works on its own: both stay,
    and where they write the same key the one that ends last counts."""
    root = fresh_folder(spark, "race")
    best = settle(
        deliveries(spark, folder)
        .groupBy("file_hash", "measurement_type")
        .agg(F.min("path").alias("lowest"), F.max("path").alias("highest"))
    )

    def rows(column, where):
        return best.where(where).select(
            "file_hash",
            "measurement_type",
            F.lit(S.SCHEMA_VERSION).alias("schema_version"),
            F.col(column).alias("source_path"),
            F.lit("2026-06-10").cast("date").alias("export_date"),
            F.current_timestamp().alias("processed_at"),
        )

    slow, fast = store.files_table(spark, root), store.files_table(spark, root)
    begun = []

    def update(current):
        if not begun:
            begun.append(True)
            fast.upsert(rows("highest", "file_hash >= '5'"))
        return store.upserted(current, rows("lowest", "file_hash < 'a'"), slow.key)

    slow.change(update)
    return slow.read().select("file_hash", "measurement_type", "source_path")


@query(
    "catalog_migrate",
    """SELECT database_name, collection_name, measurement_type, CAST(1 AS INTEGER) AS schema_version, export_date,
  CAST(export_date AS TIMESTAMP) AS exported_at, row_count, start_time, end_time, content_hash,
  '' AS source_file_hash, parquet_path FROM p""",
    views=("p",),
)
def catalog_migrate(spark, folder):
    old = partitions(spark, folder).drop("schema_version", "exported_at", "source_file_hash")
    return store.migrated(old).drop("processed_at")
