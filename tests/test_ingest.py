from __future__ import annotations

import hashlib
import random
import shutil
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airgauge import schema as S
from airgauge.operators import compare
from airgauge.operators.filters import Selection
from airgauge.plans import ingest as importing
from airgauge.plans.ingest import ingest
from airgauge.plans.staging import staging
from airgauge.session import settle
from airgauge.sources import exports, store
from airgauge.streaming.arrivals import follow

HEADERS = (
    "Time,Database,Collection,Latitude,Longitude,Operator,Model,RAN Configuration,Band Number,PCI LTE,"
    "DL EARFCN,UL EARFCN,DL Bandwidth,DL Bandwidth Aggregated,UL Bandwidth,UL Bandwidth Aggregated,"
    "Cell Type,RSRP,RSRQ,RSSI LTE,SINR"
)


def line(second, collection="c1", rsrp="-90.5", database="Db", model="phone"):
    return (
        f"2026-06-01 10:00:{second:02d},{database},{collection},38.5,-80.25,op,{model},LTE,48,7,"
        f"100,18100,10,20,5,10,PCell,{rsrp},-10,-60,12"
    )


def put(root: Path, folder: str, lines, name="lte_radio.csv", headers=HEADERS, newline="\n"):
    path = root / folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(newline.join([headers, *lines, ""]).encode())
    return str(path)


def actions(df):
    return {(r.database_name, r.collection_name, r.measurement_type): r.action for r in df.collect()}


def stored(spark, root):
    return store.read_snapshots(spark, str(root))


KEY = ("Db", "c1", "lte_radio")


def test_add_unchanged_replace_older(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "store")
    put(data, "Db/20260612", [line(1), line(2)])
    assert actions(ingest(spark, [str(data)], root)) == {KEY: "ADD"}
    # The same bytes again: nothing to do.
    assert actions(ingest(spark, [str(data)], root)) == {}
    # Same rows in another order under a newer date: unchanged, but the catalog learns of it.
    put(data, "Db/20260613", [line(2), line(1)])
    assert actions(ingest(spark, [str(data)], root)) == {KEY: "SKIP unchanged"}
    row = store.partitions_table(spark, root).read().first()
    assert str(row.exported_at) == "2026-06-13 00:00:00"
    # Newer rows replace, older ones do not.
    put(data, "Db/20260614-0900", [line(3)])
    assert actions(ingest(spark, [str(data)], root)) == {KEY: "REPLACE"}
    put(data, "Db/20260601", [line(4), line(5), line(6)])
    assert actions(ingest(spark, [str(data)], root)) == {KEY: "SKIP older"}
    assert stored(spark, root).count() == 1
    assert store.files_table(spark, root).read().count() == 4
    # Force looks at all files again; the newest still counts.
    assert actions(ingest(spark, [str(data)], root, force=True)) == {KEY: "REPLACE"}
    assert stored(spark, root).count() == 1


def test_either_order_of_exports_gives_the_same_store(spark, tmp_path):
    results = []
    for n, order in enumerate([("20260610", "20260611"), ("20260611", "20260610")]):
        root = str(tmp_path / f"store{n}")
        for folder in order:
            data = tmp_path / f"data{n}{folder}"
            put(data, folder, [line(int(folder[-1]) + 1)])
            ingest(spark, [str(data)], root)
        results.append([r.measured_at for r in stored(spark, root).collect()])
    assert results[0] == results[1] and results[0][0].second == 2


def test_missing_partitions_stay_and_rows_repeat(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "store")
    put(data, "20260610", [line(1), line(1), line(1, "c2")])
    ingest(spark, [str(data)], root)
    put(data, "20260611", [line(5), line(5)])
    assert actions(ingest(spark, [str(data)], root)) == {KEY: "REPLACE"}
    counts = {r[0]: r[1] for r in stored(spark, root).groupBy("collection_name").count().collect()}
    assert counts == {"c1": 2, "c2": 1}


def test_equal_export_time_lowest_path_counts(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "store")
    put(data, "a/20260610", [line(1)])
    put(data, "b/20260610", [line(2)])
    ingest(spark, [str(data)], root)
    assert [r.measured_at.second for r in stored(spark, root).collect()] == [1]


def test_new_schema_version_is_not_unchanged(spark, tmp_path, monkeypatch):
    data, root = tmp_path / "data", str(tmp_path / "store")
    put(data, "20260610", [line(1)])
    ingest(spark, [str(data)], root)
    monkeypatch.setattr(S, "SCHEMA_VERSION", 3)
    assert actions(ingest(spark, [str(data)], root)) == {KEY: "REPLACE"}


def test_numeric_names_and_odd_characters_stay_text(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "store")
    put(data, "My [db]/20260610", [line(1, "007", database="20260612"), line(2, "a/b=c d", database="20260612")])
    ingest(spark, [str(data)], root)
    assert sorted(r.collection_name for r in stored(spark, root).collect()) == ["007", "a/b=c d"]
    selection = Selection.of({"database": "20260612", "collections": ["007", "a/b=c d"], "technology": "LTE"})
    assert store.read_selection(spark, root, selection).count() == 2


def test_selection_with_lost_partition_is_an_error(spark, tmp_path):
    data, root = tmp_path / "data", tmp_path / "store"
    put(data, "20260610", [line(1)])
    ingest(spark, [str(data)], str(root))
    selection = Selection.of({"database": "Db", "collections": ["c1"]})
    assert store.read_selection(spark, str(root), selection).count() == 1
    (root / "measurements").rename(tmp_path / "elsewhere")
    with pytest.raises(FileNotFoundError):
        store.read_selection(spark, str(root), selection)
    nothing = Selection.of({"database": "Db", "collections": ["other"]})
    assert store.read_selection(spark, str(root), nothing).count() == 0


def test_bad_files_stop_the_import(spark, tmp_path):
    root = str(tmp_path / "store")
    put(tmp_path / "rows", "20260610", [line(1), line(2).replace("2026-06-01 10:00:02", "when")])
    with pytest.raises(ValueError, match="1 rows without a time, database or collection"):
        ingest(spark, [str(tmp_path / "rows")], root)
    put(tmp_path / "folder", "june", [line(1)])
    with pytest.raises(ValueError, match="YYYYMMDD"):
        ingest(spark, [str(tmp_path / "folder")], root)
    put(tmp_path / "columns", "20260610", [line(1)], headers=HEADERS.replace("RSRP", "X").replace("Band Number", "Y"))
    with pytest.raises(ValueError, match=r"no header for band_number \(band_number or band\), rsrp_dbm \(rsrp\)"):
        ingest(spark, [str(tmp_path / "columns")], root)
    assert store.partitions_table(spark, root).read().count() == 0


def test_other_files_are_left_out(spark, tmp_path):
    data = tmp_path / "data"
    put(data, "20260610", [line(1)], name="LTE_RADIO.CSV")
    put(data, "20260610", [line(1)], name="notes.csv")
    put(data, "20260610", [line(1)], name="nr_radio.txt")
    put(data, "_temp/20260610", [line(1)])
    found = exports.discover(exports.list_files(spark, [str(data)]))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["LTE_RADIO.CSV"]


def test_filtered_kind(spark):
    columns = [c for c in S.COLUMNS["pdsch"] if isinstance(c.lte, S.Headers)]
    names = [c.lte.names[0] for c in columns] + ["Test Name", "direction", "TEST STATUS"]
    base = {c.lte.names[0]: "1" for c in columns} | {"time": "2026-06-12 10:00:00", "lte_net_pdsch_throughput": "2500"}
    tests = [
        ("Capacity", "Downlink", "Completed"), (" OOKLA(R) ", "downlink", "completed"), ("Ping", "Downlink", "Completed"),
        ("Capacity", "Uplink", "Completed"), ("Capacity", "Downlink", "Failed"), (None, "Downlink", "Completed"),
    ]
    rows = spark.createDataFrame(
        [tuple(base[c.lte.names[0]] for c in columns) + t for t in tests], ", ".join(f"`{n}` string" for n in names)
    )
    got = exports.canonicalize(rows, "lte_pdsch").collect()
    assert len(got) == 2
    assert {(r.technology, r.dl_scs_khz, r.ssb_index, r.throughput_mbps) for r in got} == {("LTE", 15, None, 2.5)}
    with pytest.raises(ValueError, match=r"row filter \(direction\)"):
        exports.canonicalize(rows.drop("direction"), "lte_pdsch")


@pytest.mark.parametrize("kind", list(S.KINDS))
def test_every_kind_has_its_columns(spark, kind):
    category, technology = S.KINDS[kind]
    headers = [c.source(technology).names[-1] for c in S.COLUMNS[category] if isinstance(c.source(technology), S.Headers)]
    headers += [name for name, _ in S.ROW_FILTERS.get(category, ())]
    rows = spark.createDataFrame([], ", ".join(f"`{h}` string" for h in headers))
    got = exports.canonicalize(rows, kind)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in S.measurement_struct(kind)]


def test_preferred_and_repeated_headers(spark):
    struct = "`pci` string, `PCI LTE` string, `other` string"
    rows = spark.createDataFrame([("1", "2", "x")], struct)
    headers = {c: c for c in rows.columns} | {
        c.lte.names[0]: "other" for c in S.COLUMNS["radio"] if isinstance(c.lte, S.Headers) and c.name != "pci"
    }
    assert exports.canonicalize(rows, "lte_radio", headers).first().pci == 2
    assert exports.resolve(["Dup", "a", "dup"]) == {"dup": 0, "a": 1}


def read(spark, path):
    files = exports.described(spark, [path]).cache()
    assert files.where("problem IS NOT NULL").count() == 0
    return files.first(), exports.read_canonical(spark, files)


def test_file_forms(spark, tmp_path):
    """BOM, CRLF, other delimiter, short rows, repeated header, quotes and line ends in cells."""
    wanted = tmp_path / "data" / "20260610"
    wanted.mkdir(parents=True)
    body = line(1, model='"a ""q"", b"') + "\r\n" + "2026-06-01 10:00:02,Db,c1,38.5\r\n"
    (wanted / "lte_radio.csv").write_bytes(("\ufeff" + HEADERS + ",Time\r\n" + body).encode())
    about, rows = read(spark, str(tmp_path / "data"))
    assert not about.multi_line and about.delimiter == "," and about.width == 22
    rows = rows.orderBy("measured_at").collect()
    assert [(r.measured_at.second, r.model, r.rsrp_dbm) for r in rows] == [(1, 'a "q", b', -90.5), (2, None, None)]
    assert {(r.technology, r.dl_scs_khz, r.measurement_type) for r in rows} == {("LTE", 15, "lte_radio")}

    semicolon = [line(3).replace(",", ";")]
    put(tmp_path / "semi", "20260610", semicolon, headers=HEADERS.replace(",", ";").replace("RSRP", '"RSRP"'))
    about, rows = read(spark, str(tmp_path / "semi"))
    assert about.delimiter == ";" and rows.first().pci == 7

    put(tmp_path / "multi", "20260610", [line(4, model='"two\nlines"'), line(5)], headers='"a, b",' + HEADERS)
    put(tmp_path / "multi", "20260611", ["x," + line(4, model='"two\nlines"')], headers='"a, b",' + HEADERS)
    about, rows = read(spark, str(tmp_path / "multi" / "20260611"))
    assert about.multi_line and [(r.model, r.pci) for r in rows.collect()] == [("two\nlines", 7)]


def test_one_plan_for_any_number_of_headers(spark, tmp_path):
    """Header variants are rows of a table, not branches of the plan."""
    rng = random.Random(1)
    names, values = HEADERS.split(","), line(1).split(",")

    def variants(folder, count):
        for i in range(count):
            order = rng.sample(range(len(names)), len(names))
            cells = [values[j] if names[j] != "Collection" else f"c{i}" for j in order]
            put(tmp_path / folder, f"{i}/20260610", [",".join(cells)], headers=",".join(names[j] for j in order))
        files = settle(exports.described(spark, [str(tmp_path / folder)]))
        rows = exports.read_canonical(spark, files)
        return rows, rows._jdf.queryExecution().optimizedPlan().toString().count("\n")

    _, small = variants("one", 1)
    rows, large = variants("many", 300)
    assert large == small
    assert rows.where("pci = 7 AND rsrp_dbm = -90.5 AND operator_name = 'op'").select("collection_name").distinct().count() == 300


def test_contents_of_files(spark, tmp_path):
    put(tmp_path, "a b [c]/20260610", [line(i % 60, model='"x, y"') for i in range(500)])
    put(tmp_path, "d/20260610", [line(1, model='"two\nlines"')], newline="\r\n")
    put(tmp_path, "_temp/20260610", [line(1)] * 3000)
    found = exports.contents(spark, [str(tmp_path)], exports.archived_export).collect()
    assert sorted(r.multi_line for r in found) == [False, True]
    for r in found:
        assert r.file_hash == hashlib.sha256(Path(r.path.removeprefix("file:")).read_bytes()).hexdigest()
        assert r.header == HEADERS
    # Files that are not wanted are not opened: Spark would refuse one of this size.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100000")
    try:
        assert len(exports.contents(spark, [str(tmp_path)], exports.archived_export).collect()) == 2
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    problems = {r.problem for r in exports.described(spark, [str(tmp_path)], most_bytes=10_000).collect()}
    assert problems == {None, "larger than 10000 bytes"}


def test_first_database_of_files(spark, tmp_path):
    put(tmp_path, "a b", [line(1, database="  "), line(2, database=" First "), line(3, database="Second")])
    put(tmp_path, "c", [line(i % 60, database=f"D{i}") for i in range(2000)], headers=HEADERS.replace("Time,Database", "Database,Time"))
    put(tmp_path, "d", [line(1, database=" ")])
    put(tmp_path, "e", [line(1, database='"\n"'), line(2, database='" Right\nname"')])
    put(tmp_path, "f", [line(1)], headers=HEADERS.replace("Database", "Base"))
    got = exports.first_databases(spark, exports.contents(spark, [str(tmp_path)])).collect()
    assert {r.path.split("/")[-2]: (r.value, r.has_column) for r in got} == {
        "a b": ("First", True), "c": ("2026-06-01 10:00:00", True), "d": (None, True), "e": ("Right\nname", True), "f": (None, False),
    }


def test_staging_of_a_drop_folder(spark, tmp_path):
    drop, archive = str(tmp_path / "_temp"), str(tmp_path / "_csvs")
    put(tmp_path, "_temp", [line(1)], name="LTE Radio Connected.csv")
    put(tmp_path, "_temp", [line(2, database=" "), line(3, database="B")], name="lte_radio_neig.csv")
    put(tmp_path, "_temp", [line(4)], name="NR Radio Beam.CSV")
    put(tmp_path, "_temp", [line(5)], name="notes.csv")
    put(tmp_path, "_temp", [line(6, database="")], name="nr_radio.csv")
    put(tmp_path, "_temp", [line(7)], name="nr_pusch.csv", headers=HEADERS.replace("Database", "X"))
    put(tmp_path, "_temp", [line(8)], name="nr_pdsch.csv", headers=" ")
    put(tmp_path, "_temp", [line(8)], name="lte_pdsch.txt")
    put(tmp_path, "_temp/deeper", [line(8)], name="lte_pdsch.csv")

    def plan(date="20260612", **more):
        rows = staging(spark, drop, archive, date, **more).collect()
        return {r.path.rsplit("/", 1)[1]: (r.action, r.target or r.problem) for r in rows}

    errors = {
        "notes.csv": ("ERROR", "unknown file name"), "nr_radio.csv": ("ERROR", "no Database value"),
        "nr_pusch.csv": ("ERROR", "no Database column"), "nr_pdsch.csv": ("ERROR", "no header line"),
    }
    targets = {
        "LTE Radio Connected.csv": "Db/20260612/lte_radio.csv", "lte_radio_neig.csv": "B/20260612/lte_radio_neig.csv",
        "NR Radio Beam.CSV": "Db/20260612/nr_radio_neig.csv",
    }
    assert plan() == errors | {k: ("STAGE", v) for k, v in targets.items()}
    put(tmp_path, "_csvs/Db/20260612", [line(1)], name="lte_radio.csv")
    put(tmp_path, "_csvs/B/20260612", [line(9)], name="lte_radio_neig.csv")
    put(tmp_path, "_csvs/Db/20260611", [line(9)], name="nr_radio_neig.csv")
    actions_ = dict(zip(targets, ("SKIP", "CONFLICT", "STAGE")))
    assert plan() == errors | {k: (actions_[k], v) for k, v in targets.items()}
    assert plan(force=True)["lte_radio_neig.csv"][0] == "STAGE"
    with pytest.raises(ValueError, match="no export date"):
        plan("20260231")


def test_staging_force(spark):
    files = [
        ("a", "1", "1"), ("b", "2", "2"), ("c", "3", "3"), ("c", "4", "5"), ("c", "5", "3"), ("b", "6", "x"), ("a", "7", "9"),
    ]
    new = spark.createDataFrame(files, "target string, path string, file_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x")], "target string, file_hash string")
    plan = {r.path: r.action for r in exports.staging_plan(new, old).collect()}
    assert plan == {
        "1": "SKIP", "2": "CONFLICT", "3": "STAGE", "4": "CONFLICT", "5": "SKIP", "6": "SKIP", "7": "CONFLICT",
    }
    forced = {r.path: r.action for r in exports.staging_plan(new, old, force=True).collect()}
    assert forced == {
        "1": "SKIP", "2": "STAGE", "3": "STAGE", "4": "STAGE", "5": "STAGE", "6": "STAGE", "7": "STAGE",
    }


def test_hot_partition_becomes_several_sorted_files(spark, tmp_path):
    root = str(tmp_path / "store")
    fields = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in S.store_struct().fields]
    rows = spark.range(0, 6000, 1, 12).selectExpr(*fields, "id").withColumns(
        {
            "measurement_type": F.lit("lte_radio"),
            "database_name": F.lit("db"),
            # Two thirds of the rows are copies of one row in one partition.
            "collection_name": F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)),
            "measured_at": F.lit("2026-06-12").cast("timestamp_ntz"),
        }
    ).drop("id")
    store.replace_partitions(rows, root, "2026-06-12", rows_per_file=500)
    back = store.read_snapshots(spark, root)
    assert back.count() == 6000
    sizes = [
        r["count"] for r in back.where("collection_name = 'hot'").groupBy(F.input_file_name()).count().collect()
    ]
    assert sum(sizes) == 4000 and len(sizes) >= 8 and max(sizes) <= 500
    others = back.where("collection_name <> 'hot'").select("collection_name", F.input_file_name()).distinct()
    assert others.count() == 7


def test_catalog_versions(spark, tmp_path):
    table = store.files_table(spark, str(tmp_path))
    assert table.read().count() == 0

    def rows(*pairs):
        return spark.createDataFrame(pairs, "file_hash string, source_path string").selectExpr(
            "file_hash", "'lte_radio' AS measurement_type", "2 AS schema_version", "source_path",
            "DATE '2026-06-12' AS export_date", "current_timestamp() AS processed_at",
        )

    table.upsert(rows(("a", "1"), ("b", "1")))
    table.upsert(rows(("b", "2"), ("c", "2")))
    # A version whose write broke off does not count.
    (tmp_path / "catalog/processed_files/v00000003").mkdir()
    assert sorted((r.file_hash, r.source_path) for r in table.read().collect()) == [("a", "1"), ("b", "2"), ("c", "2")]


def test_two_writers_keep_both_changes(spark, tmp_path):
    """Every writer's row is in the table in the end, however they overtake each other."""
    table = store.files_table(spark, str(tmp_path))

    def row(name):
        return spark.sql(
            f"SELECT '{name}' AS file_hash, 'lte_radio' AS measurement_type, 2 AS schema_version, 'p' AS source_path, "
            "DATE '2026-06-12' AS export_date, current_timestamp() AS processed_at"
        )

    gate, overtaken = threading.Barrier(4), []

    def write(name):
        def update(current):
            if name not in overtaken:  # all start from the same version
                overtaken.append(name)
                gate.wait(60)
            return store.upserted(current, row(name), table.key)

        table.change(update)

    writers = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r.file_hash for r in table.read().collect()) == ["w0", "w1", "w2", "w3"]
    assert table.versions() == [1, 2, 3, 4]
    assert not [p for p in (tmp_path / "catalog/processed_files").iterdir() if p.name.startswith("_staged")]


def test_a_version_number_is_given_once(spark, tmp_path, monkeypatch):
    """Also by file systems that Hadoop renames on."""
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "rows").write_text(name)
    folder = store._Folder(spark, str(tmp_path / "a"))

    class Remote:
        def getScheme(self):
            return "hdfs"

    class Files:
        def getUri(self):
            return Remote()

    uri = folder._files.getUri()
    for name, taken in (("a", True), ("b", False)):
        folder = store._Folder(spark, str(tmp_path / name))
        context = folder._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, folder._configuration)
        monkeypatch.setattr(store._Folder, "_context", lambda self, context=context: context)
        folder._files = Files()
        assert folder.becomes(str(tmp_path / "v1")) == taken
    assert (tmp_path / "v1/rows").read_text() == "a" and (tmp_path / "b/rows").exists()


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "KEPT_VERSIONS", 3)
    table = store.set_aside_table(spark, str(tmp_path))
    for i in range(5):
        table.write(spark.sql(f"SELECT '{i}' AS path, '' AS measurement_type, '' AS file_hash, '' AS problem, 1L AS length, current_timestamp() AS modified_at, current_timestamp() AS processed_at"))
    assert table.versions() == [3, 4, 5] and table.read().first().path == "4"


def test_import_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    """Between the rows and the catalog: readers see the old rows, a repeated run the new ones."""
    data, root = tmp_path / "data", tmp_path / "store"
    put(data, "20260610", [line(1), line(1, "c2")])
    ingest(spark, [str(data)], str(root))
    opened = stored(spark, root)
    put(data, "20260611", [line(2), line(3)])

    def broken(plan, run):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(importing, "_catalog_rows", broken)
        with pytest.raises(RuntimeError, match="lost"):
            ingest(spark, [str(data)], str(root))
    assert sorted(r.measured_at.second for r in stored(spark, root).collect()) == [1, 1]
    assert store.sweep(spark, str(root)) == []  # too young
    (left,) = store.sweep(spark, str(root), older_than=-60)
    assert left.startswith("measurements/run=")
    ingest(spark, [str(data)], str(root))
    assert sorted(r.measured_at.second for r in stored(spark, root).collect()) == [1, 2, 3]
    # A reader that started before keeps its rows while the old version is kept.
    assert sorted(r.measured_at.second for r in opened.collect()) == [1, 1]
    assert store.sweep(spark, str(root), older_than=-60) == []
    monkeypatch.setattr(store, "KEPT_VERSIONS", 1)
    store.partitions_table(spark, str(root)).change(lambda rows: rows)
    (left,) = store.sweep(spark, str(root), older_than=-60)
    assert "collection_name=c1" in left
    assert sorted(r.measured_at.second for r in stored(spark, root).collect()) == [1, 2, 3]


def test_older_import_that_commits_last_loses(spark, tmp_path, monkeypatch):
    """Two imports decide on the same catalog; the newer export stays, whichever is cataloged last."""
    data, root = tmp_path / "data", str(tmp_path / "store")
    put(data, "a/20260610", [line(1)])
    put(data, "b/20260611", [line(2)])
    catalog_rows = importing._catalog_rows

    def overtaken(plan, run):
        monkeypatch.setattr(importing, "_catalog_rows", catalog_rows)
        ingest(spark, [str(data / "b")], root)
        return catalog_rows(plan, run)

    monkeypatch.setattr(importing, "_catalog_rows", overtaken)
    assert actions(ingest(spark, [str(data / "a")], root)) == {KEY: "ADD"}
    assert [r.measured_at.second for r in stored(spark, root).collect()] == [2]


def test_bad_files_are_set_aside_until_they_are_mended(spark, tmp_path):
    data, root, checkpoint = tmp_path / "data", str(tmp_path / "store"), str(tmp_path / "progress")
    put(data, "a/20260610", [line(1, "c1")])
    bad = put(data, "b/20260610", [line(2, "c2"), line(3, "c2").replace("2026-06-01 10:00:03", "when")])
    put(data, "c/june", [line(4, "c3")])
    put(data, "d/20260610", [line(5, "c4")], headers=HEADERS.replace("RSRP", "X"))
    put(data, "e/20260610", [], headers=" ")

    def follow_():
        follow(spark, str(data), root, checkpoint).awaitTermination()
        problems = {r.path.split("/")[-3]: r.problem for r in store.set_aside_table(spark, root).read().collect()}
        return problems, sorted(r.collection_name for r in stored(spark, root).collect())

    problems, rows = follow_()
    assert rows == ["c1"] and set(problems) == {"b", "c", "d", "e"}
    assert problems["b"] == "1 rows without a time, database or collection" and "rsrp_dbm" in problems["d"]
    assert "YYYYMMDD" in problems["c"] and problems["e"] == "no header line"
    put(data, "f/20260610", [line(6, "c5")])  # the next batch runs
    assert follow_()[1] == ["c1", "c5"]
    Path(bad).write_text("\n".join([HEADERS, line(2, "c2"), line(3, "c2"), ""]))
    shutil.rmtree(data / "c")
    problems, rows = follow_()
    assert rows == ["c1", "c2", "c2", "c5"] and set(problems) == {"d", "e"}


def test_migration_keeps_what_is_there(spark):
    old = spark.sql(
        "SELECT 'd' AS database_name, 'c' AS collection_name, 'lte_radio' AS measurement_type, DATE '2026-01-02' AS export_date, "
        "5L AS row_count, CAST(NULL AS TIMESTAMP_NTZ) AS start_time, CAST(NULL AS TIMESTAMP_NTZ) AS end_time, "
        "'h' AS content_hash, 'p' AS parquet_path"
    )
    once = store.migrated(old)
    row = once.first()
    assert (row.schema_version, str(row.exported_at), row.source_file_hash) == (1, "2026-01-02 00:00:00", "")
    assert store.migrated(once).collect() == once.collect()


def test_stream_takes_each_file_once(spark, tmp_path):
    data, root, checkpoint = tmp_path / "data", str(tmp_path / "store"), str(tmp_path / "progress")
    put(data, "20260612", [line(1), line(2)])
    follow(spark, str(data), root, checkpoint).awaitTermination()
    assert stored(spark, root).count() == 2
    # A late, older export loses; a newer one wins; nothing is imported twice.
    put(data, "20260610", [line(3)])
    put(data, "20260613", [line(4)], name="lte_radio_neig.csv", headers=HEADERS.replace("RSSI LTE", "RSSI"))
    put(data, "20260614", [line(5)], name="notes.csv")
    follow(spark, str(data), root, checkpoint, files_per_batch=1).awaitTermination()
    kinds = {r[0]: r[1] for r in stored(spark, root).groupBy("measurement_type").count().collect()}
    assert kinds == {"lte_radio": 2, "lte_radio_neighbor": 1}
    version = len(list((tmp_path / "store/catalog/processed_files").iterdir()))
    follow(spark, str(data), root, checkpoint).awaitTermination()
    assert len(list((tmp_path / "store/catalog/processed_files").iterdir())) == version


def test_compare_notes_from_the_store(spark, tmp_path):
    data, root = tmp_path / "data", str(tmp_path / "store")
    put(data, "20260610", [line(1), line(2, rsrp="-80")])
    ingest(spark, [str(data)], root)
    from airgauge.plans.measurements import compare_cdfs

    base = {"metric": "rsrp_dbm", "collections": ["c1"]}
    request = {"database": "Db", "curves": [base, {**base, "pci": "8"}, {**base, "technology": "NR"}]}
    summaries, cdfs = compare_cdfs(stored(spark, root), request, store.partitions_table(spark, root).read())
    got = {r.position: (r["count"], r.median, r.note) for r in summaries.collect()}
    assert got == {0: (2, -85.25, None), 1: (0, None, "No matching rows"), 2: (0, None, "No matching partition")}
    assert cdfs.count() == 401
    assert compare.charts(summaries).count() == 1
