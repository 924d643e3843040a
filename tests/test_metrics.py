"""Metrics against hand counts and plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.functions.naming import leading_number
from docsieve.operators import metrics as M
from docsieve.operators import report as R


def pairs(spark, tp, fp, fn, tn):
    rows = (
        [(0, "Relevant", "Relevant")] * tp + [(0, "Not Relevant", "Relevant")] * fp
        + [(0, "Relevant", "Not Relevant")] * fn + [(0, "Not Relevant", "Not Relevant")] * tn
    )
    return spark.createDataFrame(rows, "round int, label string, prediction string")


def test_confusion_golden(spark):
    r = M.binary_metrics(pairs(spark, 140, 25, 29, 606)).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (140, 25, 29, 606)
    assert [round(r[c], 4) for c in ("precision", "recall", "f1", "accuracy")] == [0.8485, 0.8284, 0.8383, 0.9325]


def test_undefined_metrics_are_zero(spark):
    r = M.binary_metrics(pairs(spark, 0, 0, 0, 3)).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_doc_tally_keeps_untested(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "pmid bigint, label string")
    scored = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "pmid bigint, correct int")
    rows = {r["pmid"]: r for r in M.doc_tally(labels, scored).collect()}
    assert (rows[1]["times_correct"], rows[1]["times_test"], round(rows[1]["pct"], 3)) == (2, 3, 66.667)
    assert (rows[2]["times_correct"], rows[2]["times_test"], rows[2]["pct"]) == (0, 0, None)
    assert [r["pmid"] for r in R.hardest_docs(M.doc_tally(labels, scored), 5).collect()] == [1, 2]


def brute_best(errors, patience):
    best, low = None, None
    for i, e in enumerate(errors, 1):
        if low is None or e < low:
            low, best = e, i
        elif i - best >= patience:
            return best
    return best


def test_best_iteration_equals_a_loop(spark):
    rng = random.Random(3)
    runs = {r: [round(rng.random(), 1) for _ in range(rng.randint(1, 40))] for r in range(60)}
    rows = [(r, i, e) for r, errs in runs.items() for i, e in enumerate(errs, 1)]
    df = spark.createDataFrame(rows, "round int, iteration int, err double")
    for patience in (1, 3, 100):
        got = {r["round"]: r["best_iteration"] for r in M.best_iteration(df, patience).collect()}
        assert got == {r: brute_best(e, patience) for r, e in runs.items()}


def test_running_median(spark):
    values = [0.3, 0.9, 0.1, 0.5, 0.7]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "experiment string, round int, f1 double")
    got = [r["f1_running_median"] for r in M.running_median(df).orderBy("round").collect()]
    assert got == pytest.approx([statistics.median(values[: i + 1]) for i in range(5)])


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "v double")
    rows = [(r["bin"], r["n"]) for r in M.histogram(df, "v", 5).orderBy("bin").collect()]
    assert rows == [(0, 2), (1, 2), (2, 1), (3, 0), (4, 1)]
    assert M.histogram(df, "v").count() == math.ceil(math.log2(6)) + 1
    with pytest.raises(Exception, match="constant"):
        M.histogram(df.where("v = 1"), "v", 3).collect()


def test_fill_rate_modes(spark):
    df = spark.createDataFrame([("a", None), ("", "x"), ("b", None), ("c", "")], "t string, k string")
    strict = {r["field"]: r["pct"] for r in M.fill_rate(df, ["t", "k"]).collect()}
    loose = {r["field"]: r["pct"] for r in M.fill_rate(df, ["t", "k"], null_is_empty=False).collect()}
    assert strict == {"t": 75.0, "k": 25.0} and loose == {"t": 75.0, "k": 75.0}


def test_best_params_tie_goes_to_first(spark):
    rows = [(0, 2, f, 0.5) for f in range(3)] + [(1, 4, f, s) for f, s in enumerate((0.4, 0.5, 0.6))] + [(2, 8, 0, 0.1)]
    df = spark.createDataFrame(rows, "param_order int, min_df int, fold int, f1 double")
    assert M.best_params(df, ["min_df"]).first()["min_df"] == 2


def test_class_balance_and_share(spark):
    df = spark.createDataFrame([("Relevant",)] * 2 + [("Not Relevant",)] * 5, "label string")
    assert M.class_balance(df).first()["factor"] == 2.5
    assert {r["label"]: round(r["pct"], 2) for r in M.class_share(df).collect()} == {
        "Relevant": 28.57, "Not Relevant": 71.43,
    }


def test_leaderboard_orders(spark):
    rng = random.Random(5)
    rows = [
        (name, i, rng.uniform(0.5, 0.9), rng.uniform(0.5, 0.9), centre + rng.uniform(-0.02, 0.02))
        for name, centre in (("res_a", 0.7), ("res_b", 0.805), ("res_c", 0.095))
        for i in range(50)
    ]
    df = spark.createDataFrame(rows, "experiment string, round int, precision double, recall double, f1 double")
    summary = R.interval_summary(df)
    numeric = [r["experiment"] for r in R.leaderboard(summary).collect()]
    by_text = [r["experiment"] for r in R.leaderboard(summary, by_text=True).collect()]
    assert numeric == ["res_b", "res_a", "res_c"]
    # "9.5 (...)" sorts above "80.5 (...)" as text
    assert by_text == ["res_c", "res_b", "res_a"]
    back = summary.select("f1_mid", leading_number("f1_text").alias("x")).collect()
    assert all(r["f1_mid"] == r["x"] for r in back)
    r = summary.first()
    assert r["iqv"] == pytest.approx(r["f1_hi"] - r["f1_lo"], abs=1e-6)


def test_percent_rounds_half_even(spark):
    from docsieve.functions.naming import percent

    df = spark.createDataFrame([(0.80125,), (0.80135,), (0.73925,), (1.0,), (0.0,)], "x double")
    assert [r[0] for r in df.select(percent("x")).collect()] == [80.1, 80.1, 73.9, 100.0, 0.0]
    assert df.select(F.count("x")).first()[0] == 5


@pytest.mark.parametrize("values", [[1.0, 2, 2, 3, 9, 10, 11, 50], list(range(400)), [0.1, 0.4]])
def test_bins_without_a_number(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "f1 double")
    edges = np.histogram_bin_edges(np.array(values, float), "auto")
    got = M.histogram(df, "f1").orderBy("bin").collect()
    assert len(got) == len(edges) - 1
    assert [r["n"] for r in got] == np.histogram(values, edges)[0].tolist()


def test_bins_where_the_middle_half_is_one_value():
    assert M.auto_bins(0.0, 5.0, 92, 0.0) == math.ceil(math.log2(92) + 1)
