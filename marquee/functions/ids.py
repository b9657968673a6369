"""Integer keys and their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_from_text(c: Column) -> Column:
    """``tt0111161`` -> 111161; a malformed id is an error."""
    return F.substring(c, 3, 2147483647).cast("bigint")


def try_key_from_text(c: Column) -> Column:
    """As :func:`key_from_text`, but null for a malformed or negative id."""
    key = F.substring(c, 3, 2147483647).try_cast("bigint")
    return F.when(key >= 0, key)


def text_from_key(c: Column) -> Column:
    """111161 -> ``tt0111161``; at least seven digits, longer keys keep all of theirs."""
    digits = c.cast("string")
    return F.concat(F.lit("tt"), F.when(F.length(digits) >= 7, digits).otherwise(F.lpad(digits, 7, "0")))
