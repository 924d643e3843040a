"""Abbreviations learned from a corpus, for cutting sentences.

A word is an abbreviation if its occurrences are followed by a full stop far more often than
words are in general.  The measure is the log-likelihood ratio of two binomial hypotheses:
that the word takes full stops as any word does, and that it nearly always takes one.  Long
words, words without inner stops and words often seen without a stop count for less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .expand import elements

# Fixed values of the published method.
SURE = 0.99  # share of full stops that an abbreviation takes
THRESHOLD = 0.3
#: Abbreviations a query can state as a literal list.
MOST = 200_000


def word_stops(df: DataFrame, col: str) -> DataFrame:
    """(word, n_with, n_without): occurrences of each word with and without a full stop after it.

    Words are blank-separated pieces without what stands at their edges, in lower case;
    pieces with a digit or without a letter are left out.  NULL text has none.
    """
    pieces = F.split(F.coalesce(F.col(col), F.lit("")), r"[\s\p{Z}]+")
    cores = F.transform(pieces, lambda p: F.lower(F.regexp_replace(p, r"^[^\p{L}\d]+|[^\p{L}\d.]+$", "")))
    wanted = F.filter(cores, lambda c: c.rlike(r"\p{L}") & ~c.rlike(r"\d"))
    stop = F.col("core").endswith(".")
    return (
        elements(df, [], wanted, "core")
        .groupBy(F.regexp_replace("core", r"\.+$", "").alias("word"))
        .agg(F.count_if(stop).alias("n_with"), F.count_if(~stop).alias("n_without"))
    )


def score(n_with: Column, n_without: Column, share: float, word: Column) -> Column:
    """The scaled log-likelihood ratio of a word, where ``share`` of all words take a full stop."""
    usual = n_with * F.log(F.lit(share)) + n_without * F.log(F.lit(1 - share))
    always = n_with * F.log(F.lit(SURE)) + n_without * F.log(F.lit(1 - SURE))
    letters = F.length(F.replace(word, F.lit("."), F.lit("")))
    inner = F.length(word) - letters + 1
    return 2 * (always - usual) * F.exp(-letters) * inner * F.pow(letters.cast("double"), -n_without)


def abbreviation_scores(df: DataFrame, col: str) -> DataFrame:
    """(word, n_with, n_without, score) of every word that takes a full stop at least once."""
    counts = materialise(word_stops(df, col), "word-stops")
    total = counts.agg(F.sum("n_with").alias("stops"), F.sum(F.col("n_with") + F.col("n_without")).alias("n")).first()
    share = (total["stops"] or 0) / max(total["n"] or 0, 1)
    share = min(max(share, 1e-12), 1 - 1e-12)
    measured = score(F.col("n_with"), F.col("n_without"), share, F.col("word"))
    return counts.where("n_with > 0").withColumn("score", measured)


def learned_abbreviations(df: DataFrame, col: str, threshold: float = THRESHOLD) -> list[str]:
    """The words whose score reaches the threshold, for :func:`..functions.text.sentences`."""
    found = abbreviation_scores(df, col).where(F.col("score") >= threshold).select("word").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} abbreviations: raise the threshold")
    return sorted(r["word"] for r in found)
