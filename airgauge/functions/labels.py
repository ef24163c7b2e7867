"""Display text that belongs to query results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airgauge import schema as S


def grouped(c: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(c, 0)


def band_choice(technology: Column, band: Column) -> Column:
    """Band value qualified by technology, such as ``LTE:48``."""
    return F.concat_ws(":", technology, band.cast("string"))


def band_text(technology: Column, band: Column) -> Column:
    prefix = F.when(technology == "LTE", F.lit("b")).otherwise(F.lit("n"))
    return F.concat(prefix, band.cast("string"))


def counted(text: Column, n: Column) -> Column:
    return F.concat(text, F.lit(" (#"), grouped(n), F.lit(")"))


def null_choice(c: Column) -> Column:
    """Value as choice text, with a marker standing for NULL."""
    return F.coalesce(c.cast("string"), F.lit(S.NULL_CHOICE))


def nan_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NaN"))


def technology_counts(lte: Column, nr: Column) -> Column:
    """``LTE(#2)+NR(#1)``; a technology without partitions is left out."""

    def part(name: str, n: Column) -> Column:
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.format_string(name + "(#%d)", n))

    joined = F.concat_ws("+", part("LTE", lte), part("NR", nr))
    return F.when(joined == "", F.lit("-")).otherwise(joined)


def or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def natural_key(c: Column) -> Column:
    """Sort key that compares digit runs as numbers and letters without case and accents."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))

    def padded(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=.)", "")
        width = F.lpad(F.length(digits).cast("string"), 6, "0")
        return F.when(part.rlike(r"^\d"), F.concat(width, digits)).otherwise(part)

    return F.collate(F.array_join(F.transform(parts, padded), ""), "UNICODE_CI_AI")


def number_text(c: Column, digits: int = 1) -> Column:
    return F.coalesce(F.format_number(c, digits), F.lit("-"))
