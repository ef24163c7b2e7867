"""Raw exports: canonical columns, files, snapshots and their import."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.functions import casts
from airgauge.functions.names import lookup
from airgauge.operators.filters import Selection, keep_test_rows
from airgauge.plans import ingest
from airgauge.session import fresh_folder, settle
from airgauge.sources import exports, store
from airgauge.streaming.arrivals import follow
from workloads.fixtures import view
from workloads.registry import query

# What the vendor columns for the row filters hold, and which rows pass.
TESTS_SQL = """CASE event_id % 5 WHEN 0 THEN ' capacity' WHEN 1 THEN 'OOKLA(R)' WHEN 2 THEN 'Ping' ELSE 'Capacity ' END"""
STATUS_SQL = "CASE WHEN event_id % 7 = 0 THEN 'Failed' ELSE ' completed' END"
PASSING_SQL = "event_id % 5 <> 2 AND event_id % 3 <> 0 AND event_id % 7 <> 0"


def header(alias: str) -> str:
    """An alias as a vendor writes it."""
    return alias.replace("_", " ").title()


def vendor_columns(kind: str) -> dict[str, str]:
    """Vendor headers of an export of ``kind`` with the text each holds, from M."""
    category, technology = S.KINDS[kind]
    columns = {}
    for column in S.COLUMNS[category]:
        source = column.source(technology)
        if isinstance(source, S.Headers):
            columns[header(source.names[0])] = f"CAST({column.name} AS STRING)"
    if category in S.ROW_FILTERS:
        right, wrong = ("downlink ", "Uplink") if category == "pdsch" else ("UPLINK", "Downlink")
        columns["Test Name"] = TESTS_SQL
        columns["Direction"] = f"CASE WHEN event_id % 3 = 0 THEN '{wrong}' ELSE '{right}' END"
        columns["Test Status"] = STATUS_SQL
    return columns


def vendor_rows(spark, folder, kind: str):
    rows = view(spark, folder, "m").where(F.col("measurement_type") == kind)
    columns = [f"{text} AS `{name}`" for name, text in vendor_columns(kind).items()]
    return rows.selectExpr("event_id", *columns)


def expected_columns(kind: str) -> str:
    category, technology = S.KINDS[kind]
    parts = []
    for column in S.COLUMNS[category]:
        source = column.source(technology)
        if isinstance(source, S.Headers):
            scale = " / 1000" if column.name in S.KILO_COLUMNS else ""
            parts.append(f"{column.name}{scale} AS {column.name}")
        else:
            value = "NULL" if source.value is None else f"'{source.value}'"
            sql_type = "VARCHAR" if column.type == S.STRING else column.type
            parts.append(f"CAST({value} AS {sql_type}) AS {column.name}")
    return ", ".join(parts)


def passing(kind: str) -> str:
    return PASSING_SQL if S.KINDS[kind][0] in S.ROW_FILTERS else "TRUE"


def _register(kind: str) -> None:
    @query(
        f"canonicalize_{kind}",
        f"""SELECT event_id, {expected_columns(kind)} FROM m
  WHERE measurement_type = '{kind}' AND {passing(kind)}""",
    )
    def run(spark, folder):
        return exports.canonicalize(vendor_rows(spark, folder, kind), kind, carry=["event_id"])


for _kind in S.KINDS:
    _register(_kind)


@query(
    "ingest_row_filter",
    """SELECT event_id FROM raw WHERE lower(trim(test_name)) IN ('capacity', 'ookla(r)')
  AND lower(trim(direction)) = 'downlink' AND lower(trim(test_status)) = 'completed'""",
    views=("raw",),
)
def ingest_row_filter(spark, folder):
    rows = view(spark, folder, "raw")
    names = {name: name for name, _ in S.ROW_FILTERS["pdsch"]}
    return keep_test_rows(rows, "pdsch", names).select("event_id")


@query(
    "validate_rows",
    """SELECT database_text AS source_path, count(*) FILTER (WHERE try_cast(time_text AS TIMESTAMP) IS NULL
    OR trim(collection_text) = '' OR collection_text IS NULL OR trim(database_text) = '') AS invalid
  FROM raw GROUP BY database_text""",
    views=("raw",),
)
def validate_rows(spark, folder):
    rows = view(spark, folder, "raw").select(
        F.col("database_text").alias("source_path"),
        F.expr(casts.time("time_text")).alias("measured_at"),
        F.expr(casts.clean_text("database_text")).alias("database_name"),
        F.expr(casts.clean_text("collection_text")).alias("collection_name"),
    )
    return exports.invalid_rows(rows)


RAW_COLUMNS = (
    "event_id", "time_text", "database_text", "collection_text", "pci_text",
    "throughput_kbps_text", "beam_text", "test_name", "direction", "test_status",
)


@query(
    "csv_scan",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, "
    + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in RAW_COLUMNS[1:])
    + " FROM raw",
    views=("raw",),
)
def csv_scan(spark, folder):
    """The raw view as CSV files, read back as text."""
    target = fresh_folder(spark, "csv")
    view(spark, folder, "raw").select(*RAW_COLUMNS).write.option("header", True).option(
        "escape", '"'
    ).csv(target)
    rows = exports.read_strings(spark, [target], RAW_COLUMNS)
    return rows.select(
        *[F.expr(casts.clean_text(f"_c{i}")).alias(c) for i, c in enumerate(RAW_COLUMNS)]
    )


@query(
    "file_hash",
    """SELECT strftime(measured_at, '%Y%m%d') AS day,
  sha256(string_agg(concat(event_id, ',', pci, ',', operator_name, chr(10)), '' ORDER BY event_id)) AS file_hash,
  min(event_id) AS first_id FROM m GROUP BY 1""",
)
def file_hash(spark, folder):
    """One text file for each day, hashed from its bytes."""
    target = fresh_folder(spark, "hashed")
    rows = view(spark, folder, "m").select(
        F.date_format("measured_at", "yyyyMMdd").alias("day"),
        "event_id",
        F.concat_ws(",", F.col("event_id").cast("string"), F.col("pci").cast("string"), "operator_name").alias("line"),
    )
    files = rows.repartition("day").sortWithinPartitions("day", "event_id")
    files.select("day", "line").write.partitionBy("day").text(target)
    hashed = exports.contents(spark, [target])
    return hashed.select(
        F.regexp_extract("path", "day=([0-9]+)", 1).alias("day"),
        "file_hash",
        F.substring_index("header", ",", 1).cast("bigint").alias("first_id"),
    )


MIXED = ("dl_channel_number", "ul_channel_number", "rsrp_dbm", "throughput_mbps", "bler", "is_serving_beam")


def has_column(name: str) -> str:
    kinds = [k for k in S.KINDS if name in S.measurement_struct(k).names]
    quoted = ", ".join(f"'{k}'" for k in kinds)
    return f"CASE WHEN measurement_type IN ({quoted}) THEN {name} END AS {name}"


@query(
    "union_kinds",
    f"SELECT event_id, measurement_type, {', '.join(has_column(c) for c in MIXED)} FROM m",
)
def union_kinds(spark, folder):
    rows = view(spark, folder, "m")
    frames = [
        rows.where(F.col("measurement_type") == kind).select(
            "event_id", "measurement_type", *S.measurement_struct(kind).names
        )
        for kind in S.KINDS
    ]
    return store.union_kinds(frames).select("event_id", "measurement_type", *MIXED)


STORED = (
    "measured_at", "database_name", "collection_name", "measurement_type",
    "operator_name", "band_number", "pci", "ssb_index", "rsrp_dbm", "throughput_mbps",
)


def all_kinds(spark, folder):
    rows = view(spark, folder, "m")
    return rows.select(*S.store_struct().names)


@query("snapshot_write", f"SELECT {', '.join(STORED)} FROM m")
def snapshot_write(spark, folder):
    root = fresh_folder(spark, "snapshots")
    store.replace_partitions(all_kinds(spark, folder), root, "2026-06-10")
    return store.read_snapshots(spark, root).select(*STORED)


@query(
    "processed_now",
    "SELECT DISTINCT measurement_type, database_name, collection_name, true AS recent FROM m",
)
def processed_now(spark, folder):
    """Catalog rows carry the time at which they were written."""
    root = fresh_folder(spark, "clock")
    before = spark.sql("SELECT current_timestamp() AS t").first().t
    store.replace_partitions(all_kinds(spark, folder), root, "2026-06-10")
    recent = F.col("processed_at").between(F.lit(before), F.current_timestamp())
    return store.partitions_table(spark, root).read().select(*S.PARTITION_KEY, recent.alias("recent"))


@query("snapshot_crash", f"SELECT {', '.join(STORED)}, CAST(1 AS BIGINT) AS removed FROM m")
def snapshot_crash(spark, folder):
    """A second write breaks off before the catalog names it: the first one's rows stay, and a
    sweep removes the folder that was left."""
    root = fresh_folder(spark, "broken")
    rows = all_kinds(spark, folder)
    store.replace_partitions(rows, root, "2026-06-10")
    store.write_snapshots(rows.withColumn("rsrp_dbm", -F.col("rsrp_dbm")), root)
    removed = store.sweep(spark, root, older_than=-60)
    return store.read_snapshots(spark, root).select(*STORED).withColumn("removed", F.lit(len(removed)).cast("bigint"))


@query(
    "snapshot_merge",
    f"""SELECT {', '.join(STORED)} FROM m WHERE technology = 'LTE' OR database_name = 'db_b'
  UNION ALL SELECT {', '.join(c if c != 'rsrp_dbm' else '-rsrp_dbm AS rsrp_dbm' for c in STORED)} FROM m
  WHERE technology = 'NR' AND database_name = 'db_a' AND operator_name = 'op_1'
  UNION ALL SELECT {', '.join(STORED)} FROM m WHERE technology = 'NR' AND database_name = 'db_a'
  QUALIFY NOT bool_or(operator_name = 'op_1') OVER (PARTITION BY measurement_type, collection_name)""",
)
def snapshot_merge(spark, folder):
    """A second write replaces the partitions it holds and leaves the others."""
    root = fresh_folder(spark, "merged")
    rows = all_kinds(spark, folder)
    store.replace_partitions(rows, root, "2026-06-10")
    newer = rows.where("technology = 'NR' AND database_name = 'db_a' AND operator_name = 'op_1'")
    store.replace_partitions(newer.withColumn("rsrp_dbm", -F.col("rsrp_dbm")), root, "2026-06-11")
    return store.read_snapshots(spark, root).select(*STORED)


@query(
    "read_selection",
    """SELECT 'found' AS outcome, collection_name, measurement_type, count(*) AS n FROM m
  WHERE database_name = 'db_a' AND collection_name IN ('col_0', 'col_1', 'col_2', 'col_3', 'col_4') AND category = 'pdsch'
  GROUP BY collection_name, measurement_type
  UNION ALL SELECT 'empty', NULL, NULL, 0
  UNION ALL SELECT 'lost', collection_name, measurement_type, 0 FROM m WHERE database_name = 'db_b'
    AND category = 'pdsch' AND collection_name = (SELECT min(collection_name) FROM m WHERE database_name = 'db_b')
    GROUP BY collection_name, measurement_type""",
)
def read_selection(spark, folder):
    """Reading by the catalog: what it names, nothing, and folders that are gone."""
    root = fresh_folder(spark, "selected")
    rows = all_kinds(spark, folder)
    store.replace_partitions(rows, root, "2026-06-10")

    def of(database, collections):
        return Selection.of({"database": database, "collections": collections, "measurement": "pdsch"})

    keys = ["collection_name", "measurement_type"]
    found = store.read_selection(spark, root, of("db_a", [f"col_{i}" for i in range(5)]))
    found = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(F.lit("found").alias("outcome"), *keys, "n")
    nothing = store.read_selection(spark, root, of("nowhere", ["col_0"]))
    empty = nothing.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("empty").alias("outcome"), *[F.lit(None).cast("string").alias(k) for k in keys], "n"
    )
    first = rows.where("database_name = 'db_b'").agg(F.min("collection_name")).first()[0]
    catalog = store.partitions_table(spark, root).read()
    for row in catalog.where(of("db_b", [first]).scope()).select("parquet_path").collect():
        store.remove(spark, f"{root}/{row.parquet_path}")
    try:
        store.read_selection(spark, root, of("db_b", [first]))
        lost = []
    except FileNotFoundError as error:
        kinds = re.findall(r"measurement_type=(\w+)", str(error))
        lost = [("lost", first, kind, 0) for kind in kinds]
    gone = spark.createDataFrame(lost, "outcome string, collection_name string, measurement_type string, n bigint")
    return found.unionByName(empty).unionByName(gone)


def csv_line(texts) -> str:
    """A CSV line. No text in M has a comma, a quote or a line end."""
    return f"concat_ws(',', {', '.join(f"coalesce({t}, '')" for t in texts)})"


def write_exports(spark, rows, folder: str, export: str, kinds) -> None:
    """Rows of M as archived export files: <folder>/<collection>/<export>/<kind>.csv."""
    columns = {kind: vendor_columns(kind) for kind in kinds}
    kind = F.col("measurement_type")
    chosen = rows.where(kind.isin(*kinds)).withColumns(
        {"home": F.concat_ws("-", "database_name", "collection_name"), "stem": kind}
    )
    cases = " ".join(f"WHEN '{k}' THEN {csv_line(c.values())}" for k, c in columns.items())
    line = F.expr(f"CASE measurement_type {cases} END")
    headers = {k: ",".join(c) for k, c in columns.items()}
    lines = chosen.select("home", "stem", F.col("event_id").alias("place"), line.alias("line"))
    heads = chosen.select("home", "stem").distinct().select(
        "home", "stem", F.lit(-1).alias("place"), lookup(F.col("stem"), headers).alias("line")
    )
    staged = fresh_folder(spark, "export")
    ordered = lines.unionByName(heads).repartition(8, "home", "stem").sortWithinPartitions(
        "home", "stem", "place"
    )
    ordered.select("home", "stem", "line").write.partitionBy("home", "stem").text(staged)
    _give_names(spark, staged, folder, export)


def _give_names(spark, staged: str, folder: str, export: str) -> None:
    """Each written file gets the name and folder the archive uses."""
    for row in exports.list_files(spark, [staged]).collect():
        parts = dict(p.split("=", 1) for p in row.path.split("/") if "=" in p)
        move(spark, row.path, f"{folder}/{parts['home']}/{export}", f"{parts['stem']}.csv")


def move(spark, path: str, folder: str, name: str) -> None:
    """Give a file another folder and name."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.rename(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))


LTE_KINDS = [k for k in S.KINDS if k.startswith("lte_")]

# The newer export has no NR files and covers the second half of the month. A
# collection without rows in that half is not part of it and keeps the older ones.
NEWER_SQL = "TIMESTAMP '2024-01-15'"


def kept(kind: str) -> str:
    if kind not in LTE_KINDS:
        return ""
    newest = "max(measured_at) OVER (PARTITION BY database_name, collection_name)"
    return f"QUALIFY measured_at >= {NEWER_SQL} OR {newest} < {NEWER_SQL}"


IMPORTED_SQL = " UNION ALL ".join(
    f"""SELECT '{kind}' AS measurement_type, database_name, collection_name, measured_at, pci, band_number, model,
  {'throughput_mbps / 1000' if S.KINDS[kind][0] in S.ROW_FILTERS else 'NULL'} AS throughput_mbps,
  {'NULL' if S.KINDS[kind][0] in S.ROW_FILTERS else 'rsrp_dbm'} AS rsrp_dbm
  FROM m WHERE measurement_type = '{kind}' AND {passing(kind)} {kept(kind)}"""
    for kind in S.KINDS
)


def two_exports(spark, folder):
    """Archive with an older export of all kinds and a newer one of the LTE kinds."""
    rows = view(spark, folder, "m")
    archive = fresh_folder(spark, "archive")

    def first():
        write_exports(spark, rows, archive, "20260610", S.KINDS)

    def second():
        newer = rows.where(F.col("measured_at") >= F.lit("2024-01-15").cast("timestamp_ntz"))
        write_exports(spark, newer, archive, "20260612-1030", LTE_KINDS)

    return archive, first, second


def imported(spark, root):
    return store.read_snapshots(spark, root).select(
        "measurement_type", "database_name", "collection_name", "measured_at", "pci",
        "band_number", "model", "throughput_mbps", "rsrp_dbm",
    )


@query("ingest_end_to_end", IMPORTED_SQL)
def ingest_end_to_end(spark, folder):
    archive, first, second = two_exports(spark, folder)
    first()
    second()
    root = fresh_folder(spark, "store")
    ingest.ingest(spark, [archive], root)
    return imported(spark, root)


@query("stream_ingest", IMPORTED_SQL)
def stream_ingest(spark, folder):
    """The two exports arrive one after the other."""
    archive, first, second = two_exports(spark, folder)
    root, checkpoint = fresh_folder(spark, "store"), fresh_folder(spark, "stream")
    for arrive in (first, second):
        arrive()
        follow(spark, archive, root, checkpoint).awaitTermination()
    return imported(spark, root)


@query(
    "ingest_catalog",
    """SELECT measurement_type, database_name, collection_name, count(*) AS row_count,
  min(measured_at) AS start_time, max(measured_at) AS end_time,
  CASE WHEN measurement_type LIKE 'lte%' AND max(measured_at) >= """ + NEWER_SQL + """
    THEN TIMESTAMP '2026-06-12 10:30:00' ELSE TIMESTAMP '2026-06-10' END AS exported_at
  FROM (""" + IMPORTED_SQL + ") GROUP BY measurement_type, database_name, collection_name",
)
def ingest_catalog(spark, folder):
    """The catalog after the newer export was imported before the older one."""
    archive, first, second = two_exports(spark, folder)
    root = fresh_folder(spark, "store")
    for arrive in (second, first):
        arrive()
        ingest.ingest(spark, [archive], root)
    return store.partitions_table(spark, root).read().select(
        *S.PARTITION_KEY, "row_count", "start_time", "end_time", "exported_at"
    )


# Collections whose LTE radio export lacks a column, and whose LTE PUSCH export has no times.
BAD_SQL = "measurement_type = 'lte_radio' AND collection_name = 'col_1'"
INCOMPLETE_SQL = "measurement_type = 'lte_pusch' AND collection_name = 'col_2'"


@query(
    "stream_errors",
    f"""WITH imported AS ({IMPORTED_SQL.replace(NEWER_SQL, "TIMESTAMP '1900-01-01'")})
  SELECT 'imported' AS outcome, measurement_type, count(*) AS n, CAST(NULL AS VARCHAR) AS problem FROM imported
    WHERE NOT ({BAD_SQL}) AND NOT ({INCOMPLETE_SQL}) GROUP BY measurement_type
  UNION ALL SELECT 'set aside', measurement_type, 1, CASE WHEN measurement_type = 'lte_radio'
    THEN concat('no header for rsrp_dbm (rsrp), in ', database_name) ELSE
    concat(count(*), ' rows without a time, database or collection, in ', database_name) END
    FROM imported WHERE {BAD_SQL} OR {INCOMPLETE_SQL} GROUP BY measurement_type, database_name
  UNION ALL SELECT 'mended', measurement_type, count(*), NULL FROM imported GROUP BY measurement_type""".replace(
        "WITH imported AS", ", imported AS", 1
    ),
)
def stream_errors(spark, folder):
    """Bad files are set aside while the others go in, and are taken once they are mended."""
    archive, root, checkpoint = (fresh_folder(spark, x) for x in ("archive", "store", "stream"))
    rows = view(spark, folder, "m")
    write_exports(spark, rows, archive, "20260610", S.KINDS)
    rows_of = {"lte_radio": BAD_SQL, "lte_pusch": INCOMPLETE_SQL}
    good = {}
    for kind, where in rows_of.items():
        for home in rows.where(where).select(F.concat_ws("-", "database_name", "collection_name")).distinct().collect():
            path = f"{archive}/{home[0]}/20260610/{kind}.csv"
            text = spark.read.text(path, wholetext=True).first()[0]
            good[path] = text
            broken = text.replace("Rsrp", "Other", 1) if kind == "lte_radio" else re.sub(r"\n[^,\n]+,", r"\n,", text)
            put_text(spark, path, broken)

    def counted(outcome):
        found = imported(spark, root).groupBy("measurement_type").agg(F.count(F.lit(1)).alias("n"))
        return found.select(F.lit(outcome).alias("outcome"), "measurement_type", "n", F.lit(None).cast("string").alias("problem"))

    follow(spark, archive, root, checkpoint).awaitTermination()
    first = settle(counted("imported"))
    database = F.regexp_extract("path", r"/(db_\w)-[^/]*/\d+/[^/]*$", 1)
    aside = settle(
        store.set_aside_table(spark, root).read().select(
            F.lit("set aside").alias("outcome"), "measurement_type", F.lit(1).cast("bigint").alias("n"),
            F.concat("problem", F.lit(", in "), database).alias("problem"),
        )
    )
    for path, text in good.items():
        put_text(spark, path, text)
    follow(spark, archive, root, checkpoint).awaitTermination()
    return first.unionByName(aside).unionByName(counted("mended"))


def put_text(spark, path: str, text: str) -> None:
    """Replace a file by another of the same name."""
    staged = fresh_folder(spark, "text")
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.text(staged)
    (part,) = [r.path for r in exports.list_files(spark, [staged]).collect()]
    store.remove(spark, path)
    folder, name = path.rsplit("/", 1)
    move(spark, part, folder, name)
