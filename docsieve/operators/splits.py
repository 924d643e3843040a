"""Stratified hold-outs and folds without ever gathering a class in one task.

The order within a class is ``md5(seed:key)``.  A small histogram over the
leading hash digits tells in which bucket a rank falls, so only the rows of
those buckets are sorted; every other row is placed by comparing its hash with
the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expand import records

BASE_SEED = 10042006  # fixed value: round i uses BASE_SEED + i
BUCKET_DIGITS = 3  # 4,096 hash buckets per class


def hash_order(seed: Column | int, key: Column | str = "pmid") -> Column:
    """Reproducible pseudo-random order of the keys."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", s.cast("string"), k.cast("string")))


def round_expand(labels: DataFrame, rounds: int) -> DataFrame:
    """Every labelled row once per round (a generator inside the row, no join)."""
    return labels.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))


def class_quota(labels: DataFrame, size: float, label: str = "label") -> DataFrame:
    """(label, n_class, quota): validation rows per class.

    ``ceil(size * n)`` rows in all; each class gets the whole part of its share
    and the left-over rows go to the largest remainders, ties by class name.
    Integer arithmetic throughout.  Fails if a class cannot fill both parts.
    """
    counts = labels.groupBy(label).agg(F.count("*").alias("n_class"))
    # One row per class: the table is as long as the label set.
    everything = Window.partitionBy()
    by_remainder = Window.orderBy(F.desc("_rest"), F.asc(label))
    shares = (
        counts.withColumn("_n", F.sum("n_class").over(everything))
        .withColumn("_val", F.ceil(F.lit(float(size)) * F.col("_n")))
        .withColumn("_base", F.expr("n_class * _val div _n"))
        .withColumn("_rest", F.col("n_class") * F.col("_val") % F.col("_n"))
        .withColumn("_left", F.col("_val") - F.sum("_base").over(everything))
        .withColumn("quota", F.col("_base") + (F.row_number().over(by_remainder) <= F.col("_left")).cast("bigint"))
    )
    too_small = F.raise_error(F.concat(F.lit("class too small for the split: "), F.col(label))).cast("bigint")
    return shares.select(
        label,
        "n_class",
        F.when(F.col("quota") * 2 > F.col("n_class"), too_small).otherwise(F.col("quota")).alias("quota"),
    )


def holdout_cuts(
    labels: DataFrame,
    rounds: int,
    size: float = 0.2,
    seed: int = BASE_SEED,
    key: str = "pmid",
    label: str = "label",
) -> DataFrame:
    """(label, cuts): per class, the hash positions that bound val and test in
    every round, as array<struct<round, val, test>> in round order.

    The rounds x rows expansion is never shuffled: it feeds a map-side histogram
    and is then filtered to the buckets a cut falls into; only their rows are
    sorted.  The result has one row per class.
    """
    rows = round_expand(labels.select(key, label), rounds).withColumn(
        "_ord", _position(F.col("round") + F.lit(seed), F.col(key))
    )
    bucket = F.substring(F.col("_ord.h"), 1, BUCKET_DIGITS)
    group = ["round", label]

    quota = class_quota(labels, size, label)
    histogram = rows.groupBy(*group, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*group).orderBy("_bucket")  # <= 4,096 rows each
    targets = F.array(
        F.struct(F.lit("val").alias("cut"), F.col("quota").alias("rank")),
        F.struct(F.lit("test").alias("cut"), (F.col("quota") * 2).alias("rank")),
    )
    cut_buckets = (
        histogram.withColumn("_upto", F.sum("_n").over(running))
        .join(F.broadcast(quota), label)  # one row per class
        .select(*group, "_bucket", "_n", "_upto", F.inline(targets))
        .where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
        .select(*group, "_bucket", "cut", (F.col("rank") - (F.col("_upto") - F.col("_n"))).alias("_need"))
    )
    in_bucket = Window.partitionBy(*group, "cut").orderBy("_ord")
    found = (
        rows.withColumn("_bucket", bucket)
        .join(F.broadcast(cut_buckets), [*group, "_bucket"])  # rounds x classes x 2 rows
        .withColumn("_rank", F.row_number().over(in_bucket))
        .where(F.col("_rank") == F.col("_need"))
        .select(*group, "cut", "_ord")
    )
    # A class with no validation row (quota 0) has no cut: all its rows train.
    every_round = quota.select(label, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    listed = (
        every_round.join(found, group, "left")
        .groupBy(*group)
        .agg(
            F.max(F.when(F.col("cut") == "val", F.col("_ord"))).alias("val"),
            F.max(F.when(F.col("cut") == "test", F.col("_ord"))).alias("test"),
        )
    )
    return listed.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("round", "val", "test"))).alias("cuts"))


def assign_splits(
    rows: DataFrame, cuts: DataFrame, seed: int = BASE_SEED, key: str = "pmid", label: str = "label"
) -> DataFrame:
    """``rows`` with ``splits``: array<struct<round, split>>, one entry per round
    in round order.

    A row only compares its own hash with its class's cuts; the broadcast table
    has one row per class.
    """

    def place(c: Column) -> Column:
        ours = _position(c["round"] + F.lit(seed), F.col(key))
        split = F.when(ours <= c["val"], "val").when(ours <= c["test"], "test").otherwise("train")
        return F.struct(c["round"].alias("round"), split.alias("split"))

    return (
        rows.join(F.broadcast(cuts), label)
        .withColumn("splits", F.transform("cuts", place))
        .drop("cuts")
    )


def rounds_of(split: str, splits: str = "splits") -> Column:
    """Rounds in which a row belongs to one part."""
    return F.transform(F.filter(splits, lambda s: s["split"] == split), lambda s: s["round"])


def holdout_splits(
    labels: DataFrame,
    rounds: int,
    size: float = 0.2,
    seed: int = BASE_SEED,
    key: str = "pmid",
    label: str = "label",
) -> DataFrame:
    """(round, key, label, split) with exact stratified val and test parts of
    all rounds, as one plan."""
    cuts = holdout_cuts(labels, rounds, size, seed, key, label)
    assigned = assign_splits(labels.select(key, label), cuts, seed, key, label)
    return records(assigned, [key, label], "splits", "round").select("round", key, label, "split")


def _position(seed: Column, key: Column) -> Column:
    """Place of a key in the order of one round."""
    return F.struct(hash_order(seed, key).alias("h"), key.alias("k"))


def stratified_folds(
    labels: DataFrame, k: int = 5, seed: int = BASE_SEED, key: str = "pmid", label: str = "label"
) -> DataFrame:
    """(key, label, fold): rank within the class modulo ``k``.

    Rank = rows in earlier hash buckets + rank inside the bucket, so the sort
    unit is a bucket and not a class.
    """
    rows = labels.select(key, label, hash_order(seed, key).alias("_h")).withColumn(
        "_bucket", F.substring("_h", 1, BUCKET_DIGITS)
    )
    histogram = rows.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(label).orderBy("_bucket")
    offsets = histogram.select(label, "_bucket", (F.sum("_n").over(running) - F.col("_n")).alias("_before"))
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_h", key)
    return (
        rows.withColumn("_rank", F.row_number().over(in_bucket))
        .join(F.broadcast(offsets), [label, "_bucket"])  # <= classes x 4,096 rows
        .select(key, label, ((F.col("_before") + F.col("_rank") - 1) % k).cast("int").alias("fold"))
    )
