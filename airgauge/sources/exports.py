"""Raw export files: discovery, headers, hashes and string rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgauge import schema as S
from airgauge.functions import names
from airgauge.functions.casts import canonical_value, quoted
from airgauge.operators.filters import keep_test_rows
from airgauge.session import broadcast_if_small, settle
from airgauge.sources.paths import glob_safe, plain_path

DELIMITERS = (",", ";", "\t", "|")
SOURCE_PATH = "source_path"

# A file's content is one value of a row while it is hashed. Measured with one task: 256 MiB
# are read with a heap of 3 GB and not with 2 GB, 500 MiB with 5 GB and not with 3 GB. Larger
# files are reported, not read.
MOST_BYTES = 256 << 20

# A line, which line feeds and carriage returns end, with an odd number of quotes.
_ODD_QUOTES = r'(?m)^[^"\r\n]*+"(?:[^"\r\n]*+"[^"\r\n]*+")*+[^"\r\n]*+$'


def _files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return reader.load([glob_safe(r) for r in roots])


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """All files at or below the given paths; contents are not read.

    ``uri`` is the path in the form that the rows of a file carry.
    """
    return _files(spark, roots).select(
        "path", "length", F.col("modificationTime").alias("modified_at"), F.col("_metadata.file_path").alias("uri")
    )


def discover(files: DataFrame) -> DataFrame:
    """Archived exports among ``files`` with kind, folder and export time.

    Drop folders, other file types and unknown names are left out.
    """
    path = F.col("path")
    known = files.where(names.is_csv(path) & ~names.in_drop_folder(path)).withColumn(
        "kind", names.kind_from_path(path)
    )
    return known.where(F.col("kind").isNotNull()).withColumns(
        {
            "folder": names.export_folder(path),
            "exported_at": names.folder_time(names.export_folder(path)),
        }
    )


def archived_export(path: Column) -> Column:
    """Whether a path is that of an archived export."""
    return names.is_csv(path) & ~names.in_drop_folder(path) & names.kind_from_path(path).isNotNull()


def contents(
    spark: SparkSession,
    roots: Sequence[str],
    wanted: Callable[[Column], Column] | None = None,
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """SHA-256, header line and quoting of the files at or below ``roots``.

    ``wanted`` is a condition on the path. It is applied to the listing, so other files are
    not opened, nor are files of more than ``most_bytes``, which have no row.
    """
    files = _files(spark, roots)
    if wanted is not None:
        files = files.where(wanted(plain_path(F.col("_metadata.file_path"))))
    text = F.col("content").cast("string")
    first_line = F.regexp_replace(F.substring_index(text, "\n", 1), "^\ufeff|\r$", "")
    return files.where(F.col("length") <= most_bytes).select(
        "path",
        "length",
        F.col("modificationTime").alias("modified_at"),
        F.col("_metadata.file_path").alias("uri"),
        F.sha2("content", 256).alias("file_hash"),
        first_line.alias("header"),
        (F.contains(text, F.lit('"')) & text.rlike(_ODD_QUOTES)).alias("multi_line"),
    )


def described(spark: SparkSession, roots: Sequence[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """All archived exports at or below ``roots`` with what is needed to read them.

    ``problem`` tells why a file cannot be read; it is null for the others.
    """
    found = discover(list_files(spark, roots))
    read = contents(spark, roots, archived_export, most_bytes)
    files = with_layout(found.join(read.select("path", "file_hash", "header", "multi_line"), "path", "left"))
    problem = (
        F.when(F.col("exported_at").isNull(), F.lit("its folder is named neither YYYYMMDD nor YYYYMMDD-HHMM"))
        .when(F.col("file_hash").isNull(), F.lit(f"larger than {most_bytes} bytes"))
        .when(F.trim("header") == "", F.lit("no header line"))
        .when(F.size("unmet") > 0, F.concat(F.lit("no header for "), F.array_join("unmet", ", ")))
    )
    return files.withColumn("problem", problem)


_STORED = {column.name: column for columns in S.COLUMNS.values() for column in columns}
_TESTS = max(map(len, S.ROW_FILTERS.values()))


def _kinds(spark: SparkSession) -> DataFrame:
    """What each kind takes from an export: for every stored column the header tokens it accepts
    or its fixed value, and for the row filter the tokens with the texts that pass."""
    rows = []
    for kind, (category, technology) in S.KINDS.items():
        sources = {c.name: c.source(technology) for c in S.COLUMNS[category]}
        accepted = [sources[n].names if isinstance(sources.get(n), S.Headers) else () for n in _STORED]
        fixed = [sources[n].value if isinstance(sources.get(n), S.Constant) else None for n in _STORED]
        tests = S.ROW_FILTERS.get(category, ())
        rows.append(
            (
                kind,
                [[names.header_token(x) for x in given] for given in accepted],
                [f"{n} ({' or '.join(given)})" for n, given in zip(_STORED, accepted)],
                [None if x is None else str(x) for x in fixed],
                [names.header_token(name) for name, _ in tests],
                [[text.lower() for text in texts] for _, texts in tests],
            )
        )
    struct = (
        "kind string, accepted array<array<string>>, wording array<string>, fixed array<string>, "
        "tests array<string>, passing array<array<string>>"
    )
    return spark.createDataFrame(rows, struct)


def with_tokens(files: DataFrame) -> DataFrame:
    """``files`` (header) with the ``delimiter``, the header's ``tokens`` and their number, ``width``."""

    def count(delimiter: str) -> Column:
        return F.length("header") - F.length(F.replace(F.col("header"), F.lit(delimiter), F.lit("")))

    most = F.greatest(*[count(d) for d in DELIMITERS])
    delimiter = F.coalesce(*[F.when(count(d) == most, F.lit(d)) for d in DELIMITERS])
    cells = F.coalesce(
        *[
            # A delimiter that an even number of quotes follows is outside of them.
            F.when(F.col("delimiter") == d, F.split("header", rf'[{d}](?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'))
            for d in DELIMITERS
        ]
    )
    found = files.withColumn("delimiter", delimiter).withColumn("tokens", F.transform(cells, names.text_token))
    return found.withColumn("width", F.size("tokens"))


def _place(token: Column) -> Column:
    """Cell of the first header with this token, null if there is none."""
    return (F.nullif(F.array_position("tokens", token), F.lit(0).cast("bigint")) - 1).cast("int")


def with_layout(files: DataFrame) -> DataFrame:
    """``files`` (kind, header) with the layout of each, as data.

    Added are the ``delimiter``, the number of cells (``width``), the cell of every stored
    column (``places``; null for one with a fixed value or none), the ``fixed`` values, the
    cells of the row filter (``test_places``) with the texts that pass, and what no header
    stands for (``unmet``). Of headers with equal tokens the first counts, of accepted
    headers the one named first.
    """

    def first(tokens: Column) -> Column:
        return F.get(F.filter(F.transform(tokens, _place), lambda p: p.isNotNull()), F.lit(0))

    kinds = F.broadcast(_kinds(files.sparkSession))  # one row for each kind
    placed = (
        with_tokens(files)
        .join(kinds, "kind")
        .withColumns(
            {"places": F.transform("accepted", first), "test_places": F.transform("tests", _place)}
        )
    )
    lacking = F.filter(
        F.arrays_zip("wording", "accepted", "places"),
        lambda x: (F.size(x["accepted"]) > 0) & x["places"].isNull(),
    )
    untested = F.filter(F.arrays_zip("tests", "test_places"), lambda x: x["test_places"].isNull())
    unmet = F.concat(
        F.transform(lacking, lambda x: x["wording"]),
        F.transform(untested, lambda x: F.concat(F.lit("row filter ("), x["tests"], F.lit(")"))),
    )
    return placed.withColumn("unmet", unmet).drop("tokens", "accepted", "wording", "tests")


_LAYOUT = ("kind", "places", "fixed", "test_places", "passing")


def read_cells(
    spark: SparkSession, paths: Sequence[str], width: int, delimiter: str = ",", multi_line: bool = False
) -> DataFrame:
    """Rows of files of any headers, all values as one array of texts.

    ``source_path`` tells the file of a row and ``block`` where in it the row was read.
    """
    rows = read_strings(spark, paths, [""] * width, delimiter, multi_line)
    cells = F.array(*[f"_c{i}" for i in range(width)]).alias("cells")
    return rows.select(SOURCE_PATH, F.col("_metadata.file_block_start").alias("block"), cells)


def _all_cells(spark: SparkSession, files: DataFrame) -> DataFrame | None:
    """Rows of all ``files`` (path, delimiter, multi_line, width), read in one form for each
    delimiter and quoting, however many headers there are."""
    forms = files.groupBy("delimiter", "multi_line").agg(
        F.max("width").alias("width"), F.sort_array(F.collect_list("path")).alias("paths")
    )
    rows = None
    for form in sorted(forms.collect(), key=lambda r: (r.delimiter, r.multi_line)):
        cells = read_cells(spark, form.paths, form.width, form.delimiter, form.multi_line)
        rows = cells if rows is None else rows.unionByName(cells)
    return rows


def read_canonical(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Canonical rows of described files that have no problem, of all kinds together.

    Columns are those of the store and ``source_path``. The plan is the same for any
    number of files and headers: a file's layout is a row that is joined to its cells.
    """
    cells = _all_cells(spark, files)
    if cells is None:
        return spark.createDataFrame([], T.StructType([*S.store_struct().fields, T.StructField(SOURCE_PATH, T.StringType())]))
    layouts = files.select(F.col("uri").alias(SOURCE_PATH), *_LAYOUT)
    rows = cells.join(broadcast_if_small(layouts), SOURCE_PATH)
    for i in range(_TESTS):
        rows = rows.where(
            f"get(test_places, {i}) IS NULL OR array_contains(get(passing, {i}), lower(trim(get(cells, get(test_places, {i})))))"
        )
    texts = [f"if(places[{i}] IS NULL, fixed[{i}], get(cells, places[{i}])) AS {n}" for i, n in enumerate(_STORED)]
    values = {n: f"{canonical_value(n, column)} AS {n}" for n, column in _STORED.items()}
    values["measurement_type"] = "kind AS measurement_type"
    return rows.selectExpr(SOURCE_PATH, "kind", *texts).selectExpr(
        *[values[n] for n in S.store_struct().names], SOURCE_PATH
    )


def read_strings(
    spark: SparkSession,
    paths: Sequence[str],
    headers: Sequence[str],
    delimiter: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """Rows of files with the same headers; every value is text, columns go by place.

    Column ``_c0`` is the first header and so on, so repeated headers do no harm.
    Short rows end in NULLs. ``source_path`` tells the file of a row, in the
    URL-encoded form of the reader, which costs nothing per row.
    """
    struct = T.StructType(
        [T.StructField(f"_c{i}", T.StringType(), True) for i in range(len(headers))]
    )
    rows = (
        spark.read.schema(struct)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", delimiter)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .csv([glob_safe(p) for p in paths])
    )
    return rows.withColumn(SOURCE_PATH, F.col("_metadata.file_path"))


def resolve(headers: Sequence[str]) -> dict[str, int]:
    """Place of each header by its token; the first of equal tokens counts."""
    places: dict[str, int] = {}
    for place, header in enumerate(headers):
        places.setdefault(names.header_token(header), place)
    return places


@dataclass(frozen=True)
class Projection:
    """What a header line gives for a kind: an expression of each canonical column.

    ``unmet`` lists the columns, and test columns of the row filter, that no header
    stands for; a projection with any cannot be applied.
    """

    kind: str
    outputs: tuple[str, ...]
    tests: tuple[tuple[str, str], ...]
    unmet: tuple[str, ...]

    @classmethod
    def plan(cls, kind: str, sources: Mapping[str, str]) -> Projection:
        """Match the schema of ``kind`` with ``sources``, header tokens and their input columns."""
        category, technology = S.KINDS[kind]

        def match(accepted: Sequence[str]) -> str | None:
            return next(filter(None, (sources.get(names.header_token(x)) for x in accepted)), None)

        wanted = {column: column.source(technology) for column in S.COLUMNS[category]}
        given = {c: match(x.names) for c, x in wanted.items() if not isinstance(x, S.Constant)}
        tests = {name: match((name,)) for name, _ in S.ROW_FILTERS.get(category, ())}
        unmet = [f"{c.name} ({' or '.join(wanted[c].names)})" for c, found in given.items() if found is None]
        unmet += [f"row filter ({name})" for name, found in tests.items() if found is None]

        def output(column) -> str:
            if column in given:
                text = canonical_value(f"`{given[column]}`", column)
            else:
                fixed = wanted[column].value
                text = f"CAST({'NULL' if fixed is None else quoted(str(fixed))} AS {column.type})"
            return f"{text} AS {column.name}"

        outputs = () if unmet else tuple(map(output, wanted))
        return cls(kind, outputs, tuple(tests.items()), tuple(unmet))

    def apply(self, rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """The canonical rows, with the columns ``carry`` as they are."""
        if self.unmet:
            raise ValueError(f"no header of this {self.kind} export gives {', '.join(self.unmet)}")
        passing = keep_test_rows(rows, S.KINDS[self.kind][0], dict(self.tests))
        return passing.selectExpr(*self.outputs, *carry)


def canonicalize(
    rows: DataFrame,
    kind: str,
    headers: Mapping[str, str] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Rows of a raw export in the canonical columns of ``kind``.

    ``headers`` maps header text to input column; by default the input columns
    are the headers. Of headers with equal tokens the first counts.
    """
    inputs = headers or {c: c for c in rows.columns if c not in carry}
    texts, columns = list(inputs), list(inputs.values())
    sources = {token: columns[place] for token, place in resolve(texts).items()}
    return Projection.plan(kind, sources).apply(rows, carry)


def invalid_rows(rows: DataFrame, by: Sequence[str] = (SOURCE_PATH,)) -> DataFrame:
    """Number of rows of each file that lack time, database or collection."""
    lacking = (
        F.col("measured_at").isNull()
        | F.col("database_name").isNull()
        | F.col("collection_name").isNull()
    )
    return rows.groupBy(*by).agg(F.count_if(lacking).alias("invalid"))


def first_values(rows: DataFrame, value: str, group: str, order: Sequence[str]) -> DataFrame:
    """First non-blank value of each group; combined before the shuffle."""
    filled = rows.withColumn("_v", F.trim(F.col(value), F.lit(" \t\n\r\f\x0b"))).where(F.col("_v") != "")
    return filled.groupBy(group).agg(F.min_by("_v", F.struct(*order)).alias("value"))


def first_databases(spark: SparkSession, files: DataFrame) -> DataFrame:
    """First non-blank Database value of each file (path, uri, header, multi_line), by its place in the file.

    ``value`` is null for a file that has none and ``has_column`` false for one without
    that column. A file is read in blocks (in one, if values hold line ends); rows are
    ordered by block and, inside a block, in the order they are read.
    """
    headed = settle(with_tokens(files).withColumn("place", _place(F.lit("database"))))
    every = headed.select("path", "uri", F.col("place").isNotNull().alias("has_column"))
    usable = headed.where(F.col("place").isNotNull())
    cells = _all_cells(spark, usable)
    if cells is None:
        return every.withColumn("value", F.lit(None).cast("string"))
    places = broadcast_if_small(usable.select(F.col("uri").alias(SOURCE_PATH), "place"))
    rows = cells.withColumn("line", F.monotonically_increasing_id()).join(places, SOURCE_PATH)
    values = rows.withColumn("value", F.expr("get(cells, place)"))
    found = first_values(values, "value", SOURCE_PATH, ["block", "line"])
    return every.join(found.withColumnRenamed(SOURCE_PATH, "uri"), "uri", "left")


def staging_plan(incoming: DataFrame, archived: DataFrame, force: bool = False) -> DataFrame:
    """What to do with dropped files: incoming (target, path, file_hash) against archived.

    Files count in the order of their paths. The first for a free target is staged; a
    file with the bytes that its target already has is skipped; one with other bytes is
    a conflict, or takes the target's place if forced.
    """
    before = archived.select("target", F.col("file_hash").alias("archived_hash"))
    if force:  # a target has the bytes of the file before, whatever became of that file
        order = Window.partitionBy("target").orderBy("path")
        seen = incoming.join(before, "target", "left").withColumn(
            "present", F.coalesce(F.lag("file_hash").over(order), "archived_hash")
        )
    else:  # without force a target never changes once it is taken
        first = incoming.groupBy("target").agg(F.min_by(F.struct("path", "file_hash"), "path").alias("first"))
        taken = F.when(F.col("path") != F.col("first.path"), F.col("first.file_hash"))
        seen = (
            incoming.join(before, "target", "left")
            .join(first, "target")
            .withColumn("present", F.coalesce("archived_hash", taken))
            .drop("first")
        )
    action = (
        F.when(F.col("present").isNull(), F.lit("STAGE"))
        .when(F.col("present") == F.col("file_hash"), F.lit("SKIP"))
        .otherwise(F.lit("STAGE" if force else "CONFLICT"))
    )
    return seen.withColumn("action", action).drop("present")


def newest_copies(files: DataFrame) -> DataFrame:
    """One delivery for each (file_hash, kind): the newest, then the highest path."""
    keys = ["file_hash", "kind"]
    fields = [c for c in files.columns if c not in keys]
    newest = files.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.struct("exported_at", "path")).alias("d")
    )
    return newest.select(*keys, "d.*")


def unprocessed(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose bytes were not yet processed as this kind in this schema version."""
    done = processed.where(F.col("schema_version") == S.SCHEMA_VERSION).select(
        "file_hash", F.col("measurement_type").alias("kind")
    )
    return files.join(broadcast_if_small(done), ["file_hash", "kind"], "left_anti")
