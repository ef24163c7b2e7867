"""Expressions over file paths, export folders and header names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from airgauge import schema as S


def header_token(name: str) -> str:
    """Header reduced to lower-case letters and digits."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def text_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of ``c`` in a small fixed table, NULL when it is not there."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), c)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_csv(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(r".\.csv$")


def in_drop_folder(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "_temp")


def kind_from_path(path: Column) -> Column:
    """Measurement kind of an archived export, NULL when the name is unknown."""
    return lookup(F.lower(file_stem(path)), S.STEM_KINDS)


def archive_stem(path: Column) -> Column:
    """Archive stem of an archived or vendor-named export, NULL when unknown."""
    stem = F.lower(file_stem(path))
    known = F.when(stem.isin(*S.STEM_KINDS), stem)
    return F.coalesce(known, lookup(text_token(file_stem(path)), S.VENDOR_STEMS))


def stem_kind(stem: Column) -> Column:
    return lookup(stem, S.STEM_KINDS)


def export_folder(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def folder_time(folder: Column) -> Column:
    """Time of an export folder YYYYMMDD or YYYYMMDD-HHMM, NULL for anything else."""
    shape = r"^(\d{4})(\d{2})(\d{2})(?:-(\d{2})(\d{2}))?$"

    def part(i: int) -> Column:
        return F.regexp_extract(folder, shape, i)

    clock = F.when(part(4) == "", F.lit("00:00")).otherwise(F.concat_ws(":", part(4), part(5)))
    text = F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), clock)
    return F.when(folder.rlike(shape), text.try_cast("timestamp_ntz"))


def is_export_date(folder: Column) -> Column:
    return F.coalesce(folder_time(folder).isNotNull(), F.lit(False))
