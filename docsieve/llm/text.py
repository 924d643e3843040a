"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of ASCII letters, digits and all other characters from U+0080 on.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(col: str | Column) -> Column:
    """A-Z lower-cased, everything else untouched (unlike ``lower``)."""
    return F.translate(col, UPPER, LOWER)


def alnum_words(text: str | Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the ASCII-lower-cased text; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP)
    return F.filter(parts, lambda w: w != "")


def row_key(text: Column) -> Column:
    """With the id this tells rows apart: rows of one id and one text have one result."""
    return F.xxhash64(text)


def broadcast_within(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the limit; else Spark joins it by shuffling."""
    return F.broadcast(df) if rows <= limit else df
