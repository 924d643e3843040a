"""Term features and vectors against plain Python and numpy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.functions.arrays import concat_vectors, slice_vector
from docsieve.operators import features as X
from docsieve.operators import pooling
from docsieve.operators.splits import assign_splits, holdout_cuts

DOCS = [(1, ["a", "b", "a"]), (2, ["b", "##"]), (3, []), (4, ["a", "##", "##", "c"])]


def docs(spark):
    return spark.createDataFrame(DOCS, "pmid bigint, tokens array<string>")


def test_document_frequency(spark):
    got = {r["token"]: r["df"] for r in X.document_frequency(docs(spark), min_df=2).collect()}
    assert got == {"a": 2, "b": 2, "##": 2}


def test_l1_weights_with_idf(spark):
    vocabulary = X.document_frequency(docs(spark), min_df=2).withColumn("n_docs", F.lit(4))
    got = {
        (r["pmid"], r["token"]): r["weight"]
        for r in X.l1_weights(X.term_counts(docs(spark)), vocabulary, use_idf=True).collect()
    }
    idf = math.log(5 / 3) + 1
    want = {}
    for pmid, tokens in DOCS:
        raw = {t: n * idf for t, n in Counter(tokens).items() if t != "c"}
        want.update({(pmid, t): w / sum(raw.values()) for t, w in raw.items()})
    assert got == pytest.approx(want)


def test_l1_frequency_sums_to_one(spark):
    sums = X.l1_frequency(docs(spark)).groupBy("pmid").agg(F.sum("weight").alias("s")).collect()
    assert {r["pmid"] for r in sums} == {1, 2, 4} and all(r["s"] == pytest.approx(1) for r in sums)


def test_training_vocabulary_has_no_leak(spark):
    """A token held by one document only shows up in rounds that train on it."""
    rows = [(i, "a" if i % 3 else "b", [f"own{i}", "shared"]) for i in range(60)]
    df = spark.createDataFrame(rows, "pmid bigint, label string, tokens array<string>")
    placed = assign_splits(df, holdout_cuts(df.select("pmid", "label"), 6)).cache()
    found = {(r["round"], r["token"]): r["df"] for r in X.training_frequency(placed, 6, 1).collect()}
    sizes = {r["round"]: r["n_docs"] for r in X.round_sizes(placed).collect()}
    for r in placed.collect():
        for s in r["splits"]:
            assert ((s["round"], f"own{r['pmid']}") in found) == (s["split"] == "train")
    assert all(found[(i, "shared")] == sizes[i] == 36 for i in range(6))


def test_feature_count(spark):
    vectors = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    vocabulary = X.document_frequency(docs(spark))
    assert tuple(X.feature_count(vocabulary, vectors).first()) == (4, 2, 6)
    assert tuple(X.feature_count(vocabulary).first()) == (4, 0, 4)


def test_stem_rollup(spark):
    df = spark.createDataFrame([(1, ["infections", "infection", "##"]), (2, ["infection"])], "pmid bigint, tokens array<string>")
    assert {tuple(r) for r in X.stem_rollup(df).collect()} == {("infect", 2, 3), ("##", 1, 1)}
    assert X.stem_vocabulary(df).count() == 3


@pytest.mark.parametrize("width", [5, 768])
def test_pooling_equals_numpy(spark, width):
    rng = np.random.default_rng(0)
    values = rng.normal(size=(30, width))
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(values)], "k int, embedding array<double>")
    for r in pooling.pool_vectors(df, "k").collect():
        part = values[r["k"] :: 3]
        assert len(r["pooled"]) == 3 * width
        assert np.allclose(r["pooled"], np.concatenate([part.mean(0), part.max(0), part.min(0)]))
    assert {len(r["pooled"]) for r in pooling.pool_vectors(df, "k", maxmin=False).collect()} == {width}


def test_layer_sum_drops_edges(spark):
    rng = np.random.default_rng(1)
    tokens = rng.normal(size=(21, 13, 6))
    df = spark.createDataFrame(
        [(0, 0, tokens.tolist()), (0, 1, tokens[:2].tolist())], "doc int, sentence int, layers array<array<array<double>>>"
    )
    assert "Exchange" not in pooling.token_vectors(df)._jdf.queryExecution().executedPlan().toString()
    out = {r["tok"]: r["vec"] for r in pooling.token_vectors(df).collect()}
    assert sorted(out) == list(range(1, 20))
    assert all(np.allclose(v, tokens[t, -4:].sum(0)) for t, v in out.items())


def test_vector_slices(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0])], "a array<double>, t array<double>")
    r = df.select(slice_vector("a", 2).alias("s"), concat_vectors("a", "t").alias("c")).first()
    assert r["s"] == [1.0, 2.0] and r["c"] == [1.0, 2.0, 3.0, 4.0]
