"""Column builders for trimmed, blank and typed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a blank in the reference tables, upper case.
BLANK_WORDS = ("N/A", "UNKNOWN", "NOT AVAILABLE", "-")

# Java's $ also matches before a last line break, hence \z.
DATE_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
MONEY_SHAPE = r"\A[+-]?[0-9]{1,18}(?:\.[0-9]+)?\z"


def col(c: Column | str) -> Column:
    """A column by its plain name, dots included, or a column as it is."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without surrounding spaces (U+0020 only); empty becomes null."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def non_blank(c: Column | str) -> Column:
    """The trimmed value, or null where it is a blank of the reference tables."""
    t = trimmed(c)
    return F.when(~F.upper(t).isin(*BLANK_WORDS), t)


def is_date(t: Column) -> Column:
    """True for a calendar date written yyyy-mm-dd (years 0001 to 9999)."""
    return t.rlike(DATE_SHAPE) & ~t.startswith("0000") & t.try_cast("date").isNotNull()


def is_money(t: Column) -> Column:
    """True for an optional sign, 1 to 18 digits and optionally a point with digits."""
    return t.rlike(MONEY_SHAPE)


# --- text of the projected columns (blank, cast and collapse as the load defines them) ---

_ZS = r"\p{Zs}"
#: Everything that Python's str.split() takes for white space.
WHITE = r"[\s\x1c-\x1f\u0085   -     　]+"


def blank_as_null(c: Column | str) -> Column:
    """Without surrounding space separators (tabs and line breaks stay); empty becomes null."""
    return F.nullif(F.regexp_replace(col(c), rf"^{_ZS}+|{_ZS}+$", ""), F.lit(""))


def to_money(c: Column | str) -> Column:
    """decimal(20,2) with surplus digits rounded half up, null if it isn't a number or too large."""
    return blank_as_null(c).try_cast("decimal(20,2)")


def to_date(c: Column | str) -> Column:
    """A date written y-m-d, optionally with a time of day; anything else is null."""
    t = blank_as_null(c)
    return F.when(t.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}([T ]\d{2}:\d{2}:\d{2})?\z"), t.try_cast("date"))


def collapse_space(c: Column | str) -> Column:
    """Every stretch of white space as one space, none at the ends; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(col(c), WHITE, " ")), F.lit(""))


def fold_key(c: Column | str) -> Column:
    """Key under which texts that differ in case alone are the same (ß as ss; a final sigma may differ)."""
    return F.lower(F.upper(col(c)))
