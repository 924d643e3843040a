"""One row per list element.

The outer generator and a filter stand for the plain one throughout.  For the
plain form the optimiser derives a size check and pushes it down to the scan,
so an expensive list (a tokenised text) would be built a second time there.
Lists hold no NULL elements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Sequence[str | Column]


def elements(df: DataFrame, keep: Keep, items: Column | str, name: str = "token") -> DataFrame:
    """(keep, name)."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def records(df: DataFrame, keep: Keep, items: Column | str, marker: str) -> DataFrame:
    """(keep, fields of the struct elements); ``marker`` is a field that is never NULL."""
    return df.select(*keep, F.inline_outer(items)).where(F.col(marker).isNotNull())


def numbered(df: DataFrame, keep: Keep, items: Column | str, position: str, name: str) -> DataFrame:
    """(keep, position from 0, name)."""
    return df.select(*keep, F.posexplode_outer(items).alias(position, name)).where(F.col(position).isNotNull())
