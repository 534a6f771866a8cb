"""Text expressions shared by every operator: words, stripping, numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A word is a run without blank, tab, newline or carriage return; the
# characters a strip removes; the number forms that both engines and Python agree on.
WORD = r"[^ \t\n\r]+"
STRIPPED = " \t\n\r\x0b\x0c"
FLOAT_FORM = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*$"
GROUPED_NUMBER = r"[-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?"


def words(col: Column | str) -> Column:
    """Array of the words of a text; an absent text has none."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(WORD), F.lit(0))


def strip(col: Column | str) -> Column:
    """Remove surrounding whitespace of every kind."""
    return F.btrim(_c(col), F.lit(STRIPPED))


def to_float(col: Column | str) -> Column:
    """Guarded cast: NULL for anything that is not a plain decimal number."""
    return F.regexp_extract(_c(col), FLOAT_FORM, 1).try_cast("double")


def last_number(col: Column | str, default: float | None = None) -> Column:
    """Last grouped number of a text, commas removed.

    The pattern takes at most three digits before a comma group, so an unseparated 1234
    reads as 123 followed by 4.
    """
    found = F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(GROUPED_NUMBER), F.lit(0))
    value = F.regexp_replace(F.try_element_at(found, F.lit(-1)), ",", "").cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def truncated(col: Column) -> Column:
    """Whole part of a finite number, toward zero, as bigint."""
    return col.try_cast("bigint")


def last_token(col: Column | str) -> Column:
    """Last whitespace separated token of a text; NULL when there is none."""
    return F.try_element_at(words(col), F.lit(-1))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
