"""Row-wise projections, filters, lookups and key joins.

No join carries a broadcast hint: Spark broadcasts a side whose measured size
is under its threshold (AQE re-checks at run time) and shuffles beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MASK, placeholder_if_empty
from .checks import require_n_values, require_same_keys
from .expand import elements


def normalise(
    df: DataFrame, defaults: Mapping[str, str | int | float | bool], placeholder: Mapping[str, str] | None = None
) -> DataFrame:
    """Fill NULLs per column; optionally put a placeholder for empty text."""
    out = df.na.fill(dict(defaults))
    for name, value in (placeholder or {}).items():
        out = out.withColumn(name, placeholder_if_empty(name, value))
    return out


def rename_values(df: DataFrame, col: str, lookup: DataFrame) -> DataFrame:
    """Replace values by ``lookup(name, display)``; unknown values stay."""
    names = lookup.select(F.col("name").alias("_name"), F.col("display").alias("_display"))
    return (
        df.join(names, F.col(col) == F.col("_name"), "left")
        .withColumn(col, F.coalesce("_display", col))
        .drop("_name", "_display")
    )


def every_nth(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    return df.where(F.col(col) % n == 0)


def with_correct(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.withColumn("correct", (F.col(label) == F.col(prediction)).cast("int"))


def select_labelled(corpus: DataFrame, labels: DataFrame, key: str = "pmid") -> DataFrame:
    """Corpus rows whose key is labelled."""
    return corpus.join(labels.select(key), key, "left_semi")


def attach_labels(
    features: DataFrame, labels: DataFrame, strict: bool = True, key: str = "pmid", label: str = "label"
) -> DataFrame:
    """Features with their label; ``strict`` first proves equal key sets and
    exactly two labels."""
    if strict:
        require_same_keys(features, labels, key)
        require_n_values(labels, label, 2)
    return features.join(labels, key)


def attach_features(
    bow: DataFrame, embeddings: DataFrame, labels: DataFrame, strict: bool = True, key: str = "pmid"
) -> DataFrame:
    """Token table, vectors and labels on one key (one partitioning serves both joins)."""
    if strict:
        require_same_keys(bow, embeddings, key)
        require_same_keys(embeddings, labels, key)
        require_n_values(labels, "label", 2)
    return bow.join(embeddings, key).join(labels, key)


def zip_by_key(left: DataFrame, right: DataFrame, key: str = "pmid") -> DataFrame:
    """Columns of two tables side by side, paired by key."""
    return left.join(right, key)


def head(df: DataFrame, order: list, n: int = 6) -> DataFrame:
    """First rows of a total order (a top-n per task, then a merge)."""
    return df.orderBy(*order).limit(n)


def latest_by_key(df: DataFrame, order_col: str, key: str = "pmid") -> DataFrame:
    """One row per key, the highest ``order_col`` winning."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def mask_tokens(
    docs: DataFrame,
    lexicon: DataFrame,
    mask: str = MASK,
    tokens: str | Sequence[str] = "tokens",
    key: str = "pmid",
) -> DataFrame:
    """Mask the tokens found in a lexicon table (column ``token``), of any size, in one
    or several list columns.

    Only the distinct tokens of a document meet the lexicon, the hits come back by
    key, and the list is rewritten inside its row, so token order never passes a
    shuffle.  NULL words of the lexicon mask nothing; rows with a NULL key are
    masked like any other.
    """
    lists = [tokens] if isinstance(tokens, str) else list(tokens)
    words = lexicon.select(F.lower("token").alias("_word")).where("_word IS NOT NULL").distinct()
    hits = (
        elements(docs, [F.col(key).alias("_key")], F.array_distinct(F.transform(F.concat(*lists), F.lower)), "_word")
        .join(words, "_word", "left_semi")
        .groupBy("_key")
        .agg(F.collect_set("_word").alias("_hits"))
    )

    def masked(column: str) -> Column:
        hit = F.transform(column, lambda t: F.when(F.array_contains("_hits", F.lower(t)), F.lit(mask)).otherwise(t))
        return F.when(F.col("_hits").isNull(), F.col(column)).otherwise(hit)

    joined = docs.join(hits, docs[key].eqNullSafe(hits["_key"]), "left")
    return joined.withColumns({c: masked(c) for c in lists}).drop("_hits", "_key")
