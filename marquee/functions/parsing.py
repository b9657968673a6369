"""Parsers for loosely formatted metadata text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as missing, and the characters stripped from both ends of a text.
MISSING = ("", "N/A")
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def present(c: Column) -> Column:
    return c.isNotNull() & ~c.isin(*MISSING)


def _pieces(c: Column, sep: str) -> Column:
    return F.filter(F.transform(F.split(c, rf"\Q{sep}\E"), strip), lambda piece: piece != "")


def parse_list(c: Column, sep: str = ",") -> Column:
    """Split, strip and drop empties; missing text gives an empty list."""
    return F.when(present(c), _pieces(c, sep)).otherwise(F.array().cast("array<string>"))


def parse_int(c: Column) -> Column:
    """Integer with thousands separators; anything else is null."""
    return F.when(present(c), F.regexp_replace(c, ",", "").try_cast("bigint"))


def parse_float(c: Column) -> Column:
    """Finite number or null (NaN and infinities would poison minimum and maximum downstream)."""
    return F.when(present(c) & c.rlike(NUMBER), c.try_cast("double"))


def parse_minutes(c: Column) -> Column:
    """``2h 13min``, ``173 min``, ``1h``, ``90`` -> minutes; null when no digit is found."""
    text = F.lower(c)

    def number(pattern: str) -> Column:
        return F.regexp_extract(text, pattern, 1).try_cast("bigint")

    hours = F.coalesce(number(r"([0-9]+)\s*h"), F.lit(0))
    minutes = F.coalesce(number(r"([0-9]+)\s*m"), F.lit(0))
    total = hours * 60 + minutes
    return F.when(present(c), F.when(total != 0, total).otherwise(number(r"([0-9]+)")))


def parse_text(c: Column) -> Column:
    """Stripped text; missing text is null."""
    return F.when(present(c), strip(c))


def list_from_array(c: Column) -> Column:
    """List field held as an array: null -> empty, empty and null members dropped."""
    kept = F.filter(c.cast("array<string>"), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def list_from_text(c: Column) -> Column:
    """List field held as comma-separated text: null or blank -> empty."""
    return F.coalesce(_pieces(c, ","), F.array().cast("array<string>"))
