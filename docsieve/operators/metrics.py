"""Classification metrics, tallies, profiles and running statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    """Precision, recall and F1 from counts, 0 where undefined."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return {"precision": _ratio(t, t + p), "recall": _ratio(t, t + n), "f1": _ratio(t * 2, t * 2 + p + n)}


def binary_metrics(
    predictions: DataFrame,
    by: Sequence[str] = ("round",),
    positive: str = "Relevant",
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy per group, in one aggregation."""
    is_pos = F.col(label) == positive
    said_pos = F.col(prediction) == positive
    counts = predictions.groupBy(*by).agg(
        F.count_if(is_pos & said_pos).alias("tp"),
        F.count_if(~is_pos & said_pos).alias("fp"),
        F.count_if(is_pos & ~said_pos).alias("fn"),
        F.count_if(~is_pos & ~said_pos).alias("tn"),
    )
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    right = F.col("tp") + F.col("tn")
    return counts.withColumns({**prf(), "accuracy": _ratio(right, total)})


def accuracy(predictions: DataFrame, by: Sequence[str] = (), correct: str = "correct") -> DataFrame:
    return predictions.groupBy(*by).agg(F.avg(correct).alias("accuracy"), F.count("*").alias("n"))


def tally(predictions: DataFrame, by: Sequence[str] = ("pmid",), correct: str = "correct") -> DataFrame:
    """Times tested and times right per document."""
    return predictions.groupBy(*by).agg(
        F.sum(correct).cast("bigint").alias("times_correct"), F.count("*").alias("times_test")
    )


def doc_tally(labels: DataFrame, predictions: DataFrame, key: str = "pmid", correct: str = "correct") -> DataFrame:
    """Every labelled document with its tally; untested ones count 0 and have no
    percentage."""
    counted = tally(predictions, [key], correct)
    return (
        labels.join(counted, key, "left")
        .na.fill(0, ["times_correct", "times_test"])
        .withColumn("pct", F.try_divide(F.col("times_correct") * F.lit(100.0), F.col("times_test")))
    )


def class_balance(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", positive: str = "Relevant"
) -> DataFrame:
    """Class counts and the balance factor negatives / positives."""
    return (
        df.groupBy(*by)
        .agg(
            F.count_if(F.col(label) != positive).alias("n_neg"),
            F.count_if(F.col(label) == positive).alias("n_pos"),
        )
        .withColumn("factor", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")))
    )


def class_share(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, pct): counts first, then one window over the class rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()))


def fill_rate(df: DataFrame, cols: Sequence[str], null_is_empty: bool = True) -> DataFrame:
    """(field, pct) of filled values, all columns in one pass.

    ``null_is_empty=False`` counts NULL as filled.
    """
    empty = [F.length(F.col(c)) == 0 for c in cols]
    unknown = F.lit(bool(null_is_empty))
    filled = [
        F.count_if(~F.coalesce(e, unknown)).alias(f"_f{i}") for i, e in enumerate(empty)
    ]
    row = df.agg(F.count("*").alias("_n"), *filled)
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_f{i}").alias("filled")) for i, c in enumerate(cols)])
    return row.select("_n", F.inline(pairs)).select(
        "field", F.try_divide(F.col("filled") * F.lit(100.0), F.col("_n")).alias("pct")
    )


def metric_percentiles(
    metrics: DataFrame,
    by: Sequence[str] = ("experiment",),
    cols: Sequence[str] = ("precision", "recall", "f1"),
    q: Sequence[float] = (0.025, 0.5, 0.975),
    names: Sequence[str] = ("lo", "mid", "hi"),
) -> DataFrame:
    """Exact, linearly interpolated percentiles per metric.

    One group is the rounds of one experiment, a configured number.
    """
    at = F.array(*[F.lit(float(x)) for x in q])
    wide = metrics.groupBy(*by).agg(*[F.percentile(c, at).alias(f"_{c}") for c in cols])
    return wide.select(
        *by, *[F.get(f"_{c}", F.lit(i)).alias(f"{c}_{n}") for c in cols for i, n in enumerate(names)]
    )


def median_std(
    metrics: DataFrame, by: Sequence[str] = ("experiment",), cols: Sequence[str] = ("precision", "recall", "f1")
) -> DataFrame:
    """Median and sample standard deviation per metric."""
    return metrics.groupBy(*by).agg(
        *[F.percentile(c, F.lit(0.5)).alias(f"{c}_median") for c in cols],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in cols],
    )


def auto_bins(lo: float, hi: float, n: int, spread: float) -> int:
    """Number of equal bins over [lo, hi] for ``n`` values with an interquartile range ``spread``."""
    width = (hi - lo) / (math.log2(n) + 1)
    by_spread = 2 * spread / n ** (1 / 3)
    return math.ceil((hi - lo) / (min(width, by_spread) if by_spread else width))


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """(bin, lo, hi, n) of equal-width bins over [min, max], empty bins included.

    Without ``bins`` their number is that of the narrower of two widths: the span over
    log2(n) + 1, and twice the interquartile range over the cube root of n (left out where
    it is 0).  Fails on a constant column.  One pass finds the span and the quartiles (one
    row), the next counts into it.
    """
    quartiles = F.percentile(col, F.array(F.lit(0.25), F.lit(0.75)))
    span = df.agg(
        F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"), F.count(col).alias("n"),
        *([] if bins else [quartiles.alias("q")]),
    ).first()
    if span["lo"] == span["hi"]:
        raise ValueError("histogram of a constant column")
    k = bins or auto_bins(span["lo"], span["hi"], span["n"], span["q"][1] - span["q"][0])
    low, width = F.lit(span["lo"]), F.lit((span["hi"] - span["lo"]) / k)
    index = F.least(F.floor((F.col(col) - low) / width), F.lit(k - 1).cast("bigint")).alias("bin")
    counts = df.where(F.col(col).isNotNull()).groupBy(index).agg(F.count("*").alias("n"))
    # The frame adds a zero per bin, so empty bins need no join.
    frame = df.sparkSession.range(k).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("n"))
    return (
        counts.unionByName(frame)
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
        .select("bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"), "n")
    )


def running_median(
    df: DataFrame, col: str = "f1", order: str = "round", by: Sequence[str] = ("experiment",)
) -> DataFrame:
    """Median of ``col`` up to each round of an experiment."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(f"{col}_running_median", F.percentile(col, F.lit(0.5)).over(upto))


def best_iteration(
    scores: DataFrame,
    patience: int = 200,
    by: Sequence[str] = ("round",),
    order: str = "iteration",
    err: str = "err",
) -> DataFrame:
    """(by, best_iteration): the last improvement before ``patience`` iterations
    passed without one.

    An iteration improves on a strictly lower error, so the earliest of equal
    scores wins.  One group is the iterations of one fit, a configured number.
    """
    ordered = Window.partitionBy(*by).orderBy(order)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lowest_before = F.min(err).over(earlier)
    marked = scores.withColumn(
        "_improved",
        F.when(lowest_before.isNull() | (F.col(err) < lowest_before), F.col(order)),
    ).withColumn("_last", F.max("_improved").over(upto))
    stop = F.min(
        F.when(F.col(order) - F.col("_last") >= patience, F.struct(F.col(order), F.col("_last").alias("last")))
    )
    return (
        marked.groupBy(*by)
        .agg(stop.alias("_stop"), F.max("_last").alias("_final"))
        .select(*by, F.coalesce(F.col("_stop.last"), F.col("_final")).alias("best_iteration"))
    )


def mean_scores(scores: DataFrame, params: Sequence[str], score: str = "f1") -> DataFrame:
    """Mean score per parameter set over its folds."""
    return scores.groupBy(*params).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n_folds"))


def best_params(scores: DataFrame, params: Sequence[str], score: str = "f1", order: str = "param_order") -> DataFrame:
    """The set with the highest mean over folds; ties go to the lowest order."""
    means = mean_scores(scores, [order, *params], score)
    best = F.max(F.struct(F.col("mean_score"), (-F.col(order)).alias("_neg"), *params)).alias("_best")
    return means.agg(best).select(*[F.col(f"_best.{p}").alias(p) for p in params], F.col("_best.mean_score"))
