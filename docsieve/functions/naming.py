"""Experiment names and interval text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Affixes of stored feature files, and of result files.
FEATURE_AFFIXES = ("dev_", "training_", ".parquet", ".jsonl")
RESULT_PREFIX = "res_"
RESULT_PATTERN = r"/(res_[^/]*)\.csv(?:/|$)"


def experiment_name(file_name: Column | str, use_idf: bool = False, use_bow: bool = False) -> Column:
    """Experiment behind a feature file; ``_idf`` only marks the optimal fields."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    for affix in FEATURE_AFFIXES:
        name = F.replace(name, F.lit(affix), F.lit(""))
    if use_idf:
        name = F.when(F.contains(name, F.lit("optimal")), F.concat(name, F.lit("_idf"))).otherwise(name)
    if use_bow:
        name = F.concat(name, F.lit("_bow"))
    return name


def percent(col: Column | str) -> Column:
    """Share to percent with one decimal, half-even at both roundings."""
    c = F.col(col) if isinstance(col, str) else col
    return F.bround(F.bround(c, 4) * 100, 1)


def interval_text(mid: Column | str, low: Column | str, high: Column | str) -> Column:
    """``m (lo,hi)`` from values already rounded to one decimal."""
    return F.format_string("%.1f (%.1f,%.1f)", mid, low, high)


def leading_number(text: Column | str) -> Column:
    """The number before the parenthesis of an interval text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.trim(F.split_part(t, F.lit("("), F.lit(1))).cast("double")
