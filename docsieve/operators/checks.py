"""Integrity checks between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_parity(a: DataFrame, b: DataFrame, key: str = "pmid") -> DataFrame:
    """One row: keys on one side only, and keys that repeat within a side.

    Both sides are counted in one aggregation over their union, so a key with
    many copies shrinks on the map side and no join is needed.
    """
    side = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per_key = side.groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))

    def count(cond):
        return F.count_if(cond)

    return per_key.agg(
        count(F.col("_b") == 0).alias("only_left"),
        count(F.col("_a") == 0).alias("only_right"),
        count(F.col("_a") > 1).alias("repeated_left"),
        count(F.col("_b") > 1).alias("repeated_right"),
    )


def fingerprint_of(*cols: str | Column) -> Column:
    """Aggregate: the rows' number and two order-free sums of their hashes, as text.

    It adds up over tasks, so a table of any size costs one scan and a row per task.  Equal
    tables have equal fingerprints; different ones agree by chance of about 2^-128.
    """
    total = [F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")) for seed in ("one", "two")]
    return F.concat_ws(":", F.count(F.lit(1)), *[F.coalesce(t, F.lit(0)) for t in total])


def multiset_fingerprint(df: DataFrame, *cols: str) -> str:
    """:func:`fingerprint_of` of these columns (all if none is named), repeats counted."""
    return df.agg(fingerprint_of(*(cols or df.columns)).alias("f")).first()["f"]


def same_multiset(a: DataFrame, b: DataFrame, *cols: str) -> DataFrame:
    """One row (n_left, n_right, same): whether both sides hold the same rows equally often.

    Both are summed up where they lie; nothing but a row per task is moved.
    """
    sides = [
        df.agg(F.count(F.lit(1)).alias("n"), fingerprint_of(*cols).alias("f")).withColumn("side", F.lit(i)) for i, df in enumerate((a, b))
    ]

    def side(i: int, what: str) -> Column:
        return F.max(F.when(F.col("side") == i, F.col(what)))

    return sides[0].unionByName(sides[1]).agg(
        side(0, "n").alias("n_left"), side(1, "n").alias("n_right"), (side(0, "f") == side(1, "f")).alias("same")
    )


def require_same_keys(a: DataFrame, b: DataFrame, key: str = "pmid") -> None:
    """Fail unless both tables hold the same keys, each once.

    Equal sides are told by their fingerprints and only one is looked through for repeats;
    the full comparison runs where they differ, to say how.
    """
    if same_multiset(a, b, key).first()["same"] and a.groupBy(key).count().where("count > 1").isEmpty():
        return
    found = id_parity(a, b, key).first().asDict()
    if any(found.values()):
        raise ValueError(f"keys of {key!r} differ: {found}")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_distinct(col).alias("n_values"))


def require_n_values(df: DataFrame, col: str, n: int = 2) -> None:
    """Fail unless ``col`` holds exactly ``n`` distinct values."""
    found = distinct_values(df, col).first()["n_values"]
    if found != n:
        raise ValueError(f"{col!r} holds {found} distinct values, expected {n}")
