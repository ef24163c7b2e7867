"""SQL expressions that clean export text without failing on bad values.

They are kept as SQL text, because an import selects more than a hundred of
them at once. ``c`` is the text of an expression, usually a column name.
"""

from __future__ import annotations

from airgauge import schema as S


def quoted(text: str) -> str:
    """SQL literal of a text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def clean_text(c: str) -> str:
    """Outer spaces removed; blank text is NULL."""
    return f"nullif(trim({c}), '')"


def bigint(c: str) -> str:
    """Whole number; fractions round half away from zero, overflow is NULL.

    Plain digits take the short way.
    """
    rounded = f"try_cast(round(try_cast({c} AS DECIMAL(38, 10)), 0) AS BIGINT)"
    return f"coalesce(try_cast({c} AS BIGINT), {rounded})"


def double(c: str) -> str:
    """Double; a Java-style suffix (``1d``, ``1f``) or hexadecimal text is not a number.

    Text that ends in a digit has no suffix, so only the rest is matched.
    """
    suffix = rf"NOT right({c}, 1) BETWEEN '0' AND '9' AND {c} RLIKE r'[0-9.][dDfF]\s*$'"
    return f"CASE WHEN contains(lower({c}), 'x') OR {suffix} THEN NULL ELSE try_cast({c} AS DOUBLE) END"


def flag(c: str) -> str:
    """Boolean from text that has no blanks around it."""
    return rf"CASE WHEN {c} RLIKE r'^\S+$' THEN try_cast({c} AS BOOLEAN) END"


def time(c: str) -> str:
    """Zone-free timestamp from text that starts with a full date.

    ``/`` may separate the date parts, an offset in the text is ignored, and
    24:00:00 is the next midnight.
    """
    late = r"r'^\s*(\d{4}-\d{1,2}-\d{1,2})[ T]24:00:00(\.0+)?\s*$'"

    def parsed(text: str) -> str:
        midnight = f"nullif(regexp_extract({text}, {late}, 1), '')"
        return (
            f"coalesce(try_cast({text} AS TIMESTAMP_NTZ), "
            f"try_cast({midnight} AS TIMESTAMP_NTZ) + INTERVAL 1 DAY)"
        )

    slashed = r"r'^(\s*\d{4})/(\d{1,2})/(\d{1,2})'"
    return (
        rf"CASE WHEN {c} RLIKE r'^\s*\d{{4}}-\d{{1,2}}-\d{{1,2}}' THEN {parsed(c)}"
        f" WHEN {c} RLIKE {slashed}"
        f" THEN {parsed(f"regexp_replace({c}, {slashed}, '$1-$2-$3')")} END"
    )


_CASTS = {S.STRING: clean_text, S.LONG: bigint, S.DOUBLE: double, S.FLAG: flag, S.TIME: time}


def canonical_value(c: str, column: S.Column) -> str:
    """Export text turned into the stored type and unit of ``column``."""
    value = _CASTS[column.type](c)
    return f"({value}) / 1000" if column.name in S.KILO_COLUMNS else value
