"""Exact quotas, disjoint parts, brute-force order."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from docsieve.operators import splits as S

SAMPLE = [(10 + i, str(i % 2)) for i in range(10)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "pmid bigint, label string")


@pytest.mark.parametrize("size,want", [(0.2, (6, 2, 2)), (0.4, (2, 4, 4))])
def test_ten_row_sample(spark, size, want):
    out = S.holdout_splits(frame(spark, SAMPLE), 3, size).collect()
    for r in range(3):
        parts = {s: [x for x in out if x["round"] == r and x["split"] == s] for s in ("train", "val", "test")}
        assert tuple(len(parts[s]) for s in ("train", "val", "test")) == want
        for rows in parts.values():
            assert sum(x["label"] == "1" for x in rows) * 2 == len(rows)


def brute(rows, rounds, size, seed):
    """Plain Python: sort each class by md5, cut at the quotas."""
    classes = sorted({lab for _, lab in rows})
    n = len(rows)
    n_val = math.ceil(size * n)
    count = {c: sum(lab == c for _, lab in rows) for c in classes}
    quota = {c: count[c] * n_val // n for c in classes}
    left = n_val - sum(quota.values())
    for c in sorted(classes, key=lambda c: (-(count[c] * n_val % n), c))[:left]:
        quota[c] += 1
    out = set()
    for r in range(rounds):
        for c in classes:
            ids = sorted(
                (p for p, lab in rows if lab == c),
                key=lambda p: (hashlib.md5(f"{seed + r}:{p}".encode()).hexdigest(), p),
            )
            for k, p in enumerate(ids):
                part = "val" if k < quota[c] else "test" if k < 2 * quota[c] else "train"
                out.add((r, p, c, part))
    return out


@pytest.mark.parametrize("n,rate,size", [(399, 8, 0.2), (57, 3, 0.3), (1200, 5, 0.13), (20, 19, 0.1)])
def test_equals_brute_force(spark, n, rate, size):
    rows = [(i * 7 + 1, "yes" if i % rate == 0 else "no") for i in range(n)]
    got = {tuple(r) for r in S.holdout_splits(frame(spark, rows), 4, size, 77).collect()}
    assert got == brute(rows, 4, size, 77)


def test_disjoint_and_exhaustive(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(300)]
    counts = S.holdout_splits(frame(spark, rows), 5).groupBy("round", "pmid").count()
    assert counts.where("count <> 1").isEmpty() and counts.count() == 1500


def test_class_too_small_fails(spark):
    rows = [(i, "a") for i in range(9)] + [(99, "b")]
    with pytest.raises(Exception, match="class too small"):
        S.holdout_splits(frame(spark, rows), 1, 0.6).collect()


def test_class_without_quota_trains(spark):
    rows = [(i, "a") for i in range(40)] + [(99, "b")]
    out = S.holdout_splits(frame(spark, rows), 2, 0.1)
    assert {r["split"] for r in out.where("label = 'b'").collect()} == {"train"}


def test_folds_balance_classes(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(203)]
    out = S.stratified_folds(frame(spark, rows), 5)
    assert out.count() == 203
    for label in "ab":
        sizes = [r["count"] for r in out.where(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
