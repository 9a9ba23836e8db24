"""Text to typed values, as column expressions.

Input forms come from people typing into a form: dates like ``2009-1-5``,
Persian or Arabic-Indic digits, thousands separators, stray blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.schemas import MONEY

# The two non-Latin digit ranges accepted as numbers, and the
# Persian comma accepted as a list separator.
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
LATIN_DIGITS = "0123456789"
PERSIAN_COMMA = "،"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_all(col: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind (like Python
    ``str.strip()``; Spark ``trim`` removes blanks only)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def latin_digits(col: Column | str) -> Column:
    return F.translate(_c(col), PERSIAN_DIGITS + ARABIC_INDIC_DIGITS, LATIN_DIGITS * 2)


def parse_int(col: Column | str) -> Column:
    """Integer from text, NULL when not an integer. Accepts non-Latin digits."""
    return strip_all(latin_digits(col)).try_cast("int")


def parse_money(col: Column | str) -> Column:
    """Decimal(18,2) from text with thousands separators removed."""
    return strip_all(F.regexp_replace(latin_digits(col), ",", "")).try_cast(MONEY)


def parse_date(col: Column | str) -> Column:
    """Date from ``Y-M-D`` text; one- or two-digit month and day accepted,
    impossible dates give NULL (M11)."""
    return F.try_to_date(F.trim(_c(col)), "y-M-d")


def blank_to_null(col: Column | str) -> Column:
    """empty or blank text becomes NULL."""
    return F.nullif(strip_all(col), F.lit(""))


def parse_authors(col: Column | str) -> Column:
    """F8: author list text -> array of names. The Persian comma counts as a
    comma; names are stripped, blanks dropped, repeats removed keeping the
    first occurrence."""
    parts = F.split(F.translate(_c(col), PERSIAN_COMMA, ","), ",")
    names = F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(names, lambda x: x != ""))
