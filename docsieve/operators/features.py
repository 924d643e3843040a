"""Term features: counts, document frequency, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemming import stem_word
from ..functions.text import sentences, term_runs
from .expand import elements, numbered, records
from .splits import rounds_of


def term_counts(df: DataFrame, tokens: str = "tokens", key: str = "pmid") -> DataFrame:
    """(key, token, n).  Counted inside the row, so nothing is shuffled."""
    return term_rows(df, [key], tokens)


def term_rows(df: DataFrame, keep: Sequence[str | Column], tokens: str = "tokens") -> DataFrame:
    """(keep, token, n): one row per distinct token of a list."""
    return records(df, keep, term_runs(tokens), "token")


def document_frequency(
    df: DataFrame, by: Sequence[str] = (), min_df: int = 1, tokens: str = "tokens"
) -> DataFrame:
    """(by, token, df): documents holding each token, at least ``min_df``.

    Repeats are removed inside the row, so the count is one map-side combined
    sum instead of a distinct count, and a token found everywhere costs one
    partial row per task.
    """
    return (
        elements(df, by, F.array_distinct(tokens))
        .groupBy(*by, "token")
        .agg(F.count("*").alias("df"))
        .where(F.col("df") >= min_df)
    )


def training_frequency(docs: DataFrame, rounds: int, min_df: int = 2, tokens: str = "tokens") -> DataFrame:
    """(round, token, df) over the training part of every round, in one plan.

    ``docs`` carries the ``splits`` column of ``assign_splits``.  A token leaves its
    document once, whatever the number of rounds, and is counted for all of them in
    one aggregation; rounds become rows after the shuffle.
    """
    trained = F.transform("splits", lambda s: s["split"] == "train").alias("_trained")
    each = elements(docs, [trained], F.array_distinct(tokens))
    counts = each.groupBy("token").agg(*[F.count_if(F.get("_trained", F.lit(i))).alias(f"_{i}") for i in range(rounds)])
    unfolded = F.array(*[F.struct(F.lit(i).alias("round"), F.col(f"_{i}").alias("df")) for i in range(rounds)])
    return records(counts, ["token"], F.filter(unfolded, lambda r: r["df"] >= min_df), "round").select("round", "token", "df")


def round_sizes(rows: DataFrame, split: str = "train") -> DataFrame:
    """(round, n_docs) of one part, from rows with a ``splits`` column."""
    return elements(rows, [], rounds_of(split), "round").groupBy("round").agg(F.count("*").alias("n_docs"))


def l1_frequency(df: DataFrame, tokens: str = "tokens", key: str = "pmid") -> DataFrame:
    """(key, token, weight) = n / list length: L1 weights over the whole
    vocabulary, without a shuffle."""
    length = F.size(tokens)
    return term_rows(df, [key, length.alias("_len")], tokens).select(
        key, "token", (F.col("n") / F.col("_len")).alias("weight")
    )


def idf(df: str = "df", n_docs: str = "n_docs"):
    """Smoothed inverse document frequency."""
    return F.log((F.lit(1.0) + F.col(n_docs)) / (F.lit(1.0) + F.col(df))) + F.lit(1.0)


def l1_weights(
    counts: DataFrame,
    vocabulary: DataFrame,
    by: Sequence[str] = (),
    use_idf: bool = False,
    key: str = "pmid",
) -> DataFrame:
    """(by, key, token, weight) over a vocabulary table (by, token, df, n_docs).

    Tokens outside the vocabulary leave before the row sum.
    """
    factor = idf() if use_idf else F.lit(1.0)
    row = Window.partitionBy(*by, key)  # one document
    return (
        counts.join(vocabulary, [*by, "token"])
        .withColumn("_raw", F.col("n") * factor)
        .select(*by, key, "token", (F.col("_raw") / F.sum("_raw").over(row)).alias("weight"))
    )


def feature_count(vocabulary: DataFrame, vectors: DataFrame | None = None, vec: str = "embedding") -> DataFrame:
    """One row: vocabulary size, vector width and their sum."""
    terms = vocabulary.agg(F.count_distinct("token").alias("n_terms"))
    width = (
        vectors.agg(F.coalesce(F.max(F.size(vec)), F.lit(0)).cast("bigint").alias("n_vector"))
        if vectors is not None
        else terms.select(F.lit(0).cast("bigint").alias("n_vector"))
    )
    # Two one-row aggregates, stacked and summed.
    stacked = terms.select("n_terms", F.lit(0).cast("bigint").alias("n_vector")).unionByName(
        width.select(F.lit(0).cast("bigint").alias("n_terms"), "n_vector")
    )
    return stacked.agg(F.sum("n_terms").alias("n_terms"), F.sum("n_vector").alias("n_vector")).withColumn(
        "n_features", F.col("n_terms") + F.col("n_vector")
    )


def stem_vocabulary(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, stem) of the distinct vocabulary: each token is stemmed once."""
    vocabulary = elements(docs, [], F.array_distinct(tokens)).distinct()
    return vocabulary.select("token", stem_word("token").alias("stem"))


def stem_rollup(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(stem, n_forms, n): corpus counts per stem.

    Counts are first added up per token, so the stem step and the roll-up see
    the vocabulary and not the corpus.
    """
    per_token = elements(docs, [], tokens).groupBy("token").agg(F.count("*").alias("n"))
    return (
        per_token.select(stem_word("token").alias("stem"), "n")
        .groupBy("stem")
        .agg(F.count("*").alias("n_forms"), F.sum("n").alias("n"))
    )


def term_share(df: DataFrame, label: str, positive: str, min_df: int, tokens: str = "tokens") -> DataFrame:
    """(token, df, df_positive, share): how often a token's documents are positive."""
    return (
        elements(df, [(F.col(label) == positive).cast("bigint").alias("_pos")], F.array_distinct(tokens))
        .groupBy("token")
        .agg(F.count("*").alias("df"), F.sum("_pos").alias("df_positive"))
        .where(F.col("df") >= min_df)
        .withColumn("share", F.col("df_positive") / F.col("df"))
    )


def sentences_table(
    df: DataFrame, col: str = "abstract", key: str = "pmid", abbreviations: Sequence[str] = ()
) -> DataFrame:
    """(key, sentence_no, sentence)."""
    return numbered(df, [key], sentences(col, abbreviations), "sentence_no", "sentence")
