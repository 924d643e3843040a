"""Summaries and orderings for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.naming import interval_text, percent
from .metrics import metric_percentiles
from .rows import rename_values

METRICS = ("precision", "recall", "f1")
# Display names of stored result files.
DISPLAY_NAMES = {
    "res_title": "Title",
    "res_authors": "Authors",
    "res_journal": "Journal",
    "res_keywords": "Keywords",
    "res_abstract": "Abstract",
    "res_chemical": "Chemicals",
    "res_mesh": "MeSH",
    "res_pub_type": "Pub. Type",
    "res_affiliations": "Affiliations",
    "res_all": "All fields",
    "res_optimal": "Opt. Fields",
    "res_optimal_idf": "Opt. Fields IDF",
    "res_unigrams": "Unigrams",
    "res_bigrams": "Bigrams",
    "res_trigrams": "Trigrams",
    "res_specter": "SPECTER",
    "res_biobert_avg": "BioBERT\nmean pooling",
    "res_biobert_all": "BioBERT mean\n+ min&max pooling",
    "res_biobert_all_bow": "Unigrams\n+ BioBERT mean\n+ min&max pooling",
    "res_biobert_avg_bow": "Unigrams\n+ BioBERT\nmean pooling",
}


def display_names(df: DataFrame) -> DataFrame:
    """The display-name lookup as a table in ``df``'s session."""
    rows = [(k, v) for k, v in DISPLAY_NAMES.items()]
    return df.sparkSession.createDataFrame(rows, "name string, display string")


def interval_summary(metrics: DataFrame, by: Sequence[str] = ("experiment",)) -> DataFrame:
    """Median and 95 % interval per metric in percent, their text form, and
    ``iqv``, the width of the F1 interval."""
    wide = metric_percentiles(metrics, by, METRICS)
    numbers = [percent(f"{m}_{p}").alias(f"{m}_{p}") for m in METRICS for p in ("lo", "mid", "hi")]
    out = wide.select(*by, *numbers)
    texts = {f"{m}_text": interval_text(f"{m}_mid", f"{m}_lo", f"{m}_hi") for m in METRICS}
    return out.withColumns(texts).withColumn("iqv", F.round(F.col("f1_hi") - F.col("f1_lo"), 6))


def leaderboard(summaries: DataFrame, by_text: bool = False) -> DataFrame:
    """Best experiment first: median, then low end, high end and name.

    ``by_text=True`` orders the rendered F1 text instead.
    """
    return summaries.orderBy(*_best_first(by_text))


def leaderboard_order(by_text: bool = False) -> WindowSpec:
    """The same order as a window, to number the places of a leaderboard."""
    return Window.orderBy(*_best_first(by_text))


def _best_first(by_text: bool) -> list:
    if by_text:
        return [F.desc("f1_text"), F.asc("experiment")]
    return [F.desc("f1_mid"), F.desc("f1_lo"), F.desc("f1_hi"), F.asc("experiment")]


def boxplot_table(metrics: DataFrame, lookup: DataFrame | None = None, by: str = "experiment") -> DataFrame:
    """Box and whisker positions of F1 in percent, ordered by median, with
    display names."""
    q, names = (0.025, 0.25, 0.5, 0.75, 0.975), ("p2_5", "p25", "p50", "p75", "p97_5")
    wide = metric_percentiles(metrics, [by], ["f1"], q, names)
    table = wide.select(by, *[(F.col(f"f1_{n}") * 100).alias(n) for n in names])
    named = rename_values(table, by, display_names(metrics) if lookup is None else lookup)
    return named.orderBy("p50", by)


def hardest_docs(tally: DataFrame, k: int = 20) -> DataFrame:
    """Lowest share of right predictions first, untested documents last."""
    return tally.orderBy(F.asc_nulls_last("pct"), F.asc("pmid")).limit(k)


def stack_results(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Result tables of several experiments below one another, by column name."""
    out = first
    for other in others:
        out = out.unionByName(other)
    return out
