"""Trees over sparse rows: those of Spark's learner, at a cost of the stored entries."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from docsieve.plans import model as M
from docsieve.plans import trees as T
from docsieve.session import materialise

SCHEMA = StructType([StructField("pmid", LongType()), StructField("features", VectorUDT()), StructField("target", DoubleType())])


def table(spark, vectors, targets):
    rows = [(i, v, float(t)) for i, (v, t) in enumerate(zip(vectors, targets, strict=True))]
    return materialise(spark.createDataFrame(rows, SCHEMA).repartition(3))


def noisy(n, seed):
    """Sparse counts and signed dense numbers, of which two tell something."""
    rng = np.random.default_rng(seed)
    counts = rng.poisson(0.4, (n, 12)) / rng.integers(1, 9, (n, 1))
    dense = np.where(rng.random((n, 3)) < 0.1, 0, rng.normal(size=(n, 3)))
    targets = (counts[:, 3] > 0.1) ^ (dense[:, 1] > 0.3) ^ (rng.random(n) < 0.1)
    whole = np.hstack([counts, dense])
    return [Vectors.sparse(15, np.flatnonzero(x), x[np.flatnonzero(x)]) if i % 2 else Vectors.dense(x) for i, x in enumerate(whole)], targets


@pytest.mark.parametrize("depth", [2, 3])
def test_same_trees_as_the_dense_learner(spark, depth):
    rows = table(spark, *noisy(400, depth))
    params = M.TreeParams(max_depth=depth, trees=3)
    want = M.tree_classifier(params).fit(M.with_weight(rows, M.balance_factor(rows)))
    got = M.fit_trees(rows, params)
    assert [t.depth for t in got.trees] == [t.depth for t in want.trees] and got.numFeatures == 15
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
    said = {r["pmid"]: r["probability"][1] for r in want.transform(rows).collect()}
    assert {r["pmid"]: r["probability"][1] for r in got.transform(rows).collect()} == pytest.approx(said, abs=1e-9)


def test_cost_follows_the_entries(spark):
    """300 rows over 2,000,000 terms: 2.4 GB as dense bins, 900 stored entries."""
    width = 2_000_000
    vectors = [Vectors.sparse(width, sorted({i % 7 * 250_000, 1_900_000 + i, 1_999_000 + (i % 4 == 0)}), [1.0, 0.5, 2.0]) for i in range(300)]
    rows = table(spark, vectors, [i % 4 == 0 for i in range(300)])
    chain = M.open_chain(rows, M.TreeParams(max_depth=2))
    chain.grow(2)
    assert chain.now.columns == ["bins", "target", "weight", "margin"]
    assert chain.now.agg(F.sum(F.size("bins"))).first()[0] <= 900
    assert chain.model.transform(rows).where("prediction <> target").isEmpty()
    chain.close()


def test_thresholds_do_not_hang_on_where_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(T, "SAMPLE_ROWS", 100)
    rows = M.with_weight(table(spark, *noisy(400, 1)), 2.0)
    one, two = (T.layout_of(r, "pmid", 5) for r in (rows.coalesce(1), rows.repartition(7, "target", "pmid")))
    assert np.array_equal(one.starts, two.starts) and one.thresholds == pytest.approx(two.thresholds)
    assert 0 < len(one.thresholds) < len(T.layout_of(rows.limit(100), "pmid", 5).thresholds) * 2


def test_cells_as_lists_are_the_cells_as_arrays(spark, monkeypatch):
    rows = table(spark, *noisy(300, 2))
    params = M.TreeParams(max_depth=4, trees=2)
    want = M.fit_trees(rows, params).featureImportances.toArray()
    grow = T.Grower.grow

    def by_lists(self, *args):
        T.DENSE_CELLS, kept = 3, T.DENSE_CELLS
        try:
            return grow(self, *args)
        finally:
            T.DENSE_CELLS = kept

    monkeypatch.setattr(T.Grower, "grow", by_lists)
    assert M.fit_trees(rows, replace(params)).featureImportances.toArray() == pytest.approx(want)


def test_rate_draws_features(spark):
    rows = table(spark, *noisy(300, 3))
    params = M.TreeParams(max_depth=2, trees=2, feature_rate=1 / 3)
    one, two = (M.fit_trees(rows, params).featureImportances.toArray() for _ in range(2))
    assert one == pytest.approx(two)
    assert not np.allclose(one, M.fit_trees(rows, replace(params, feature_rate=1.0)).featureImportances.toArray())


def test_thresholds_of_many_values():
    """Every step of equal weight, and the lowest values where most of the weight is zero."""
    ones = np.ones(1000)
    got = T.candidate_thresholds(np.arange(1.0, 1001.0), ones, 1000.0, 31)
    assert len(got) == 31 and np.diff(got).min() >= 31 and np.diff(got).max() <= 32
    assert T.candidate_thresholds(np.arange(1.0, 1001.0), ones, 100_000.0, 31)[:3].tolist() == [0.5, 1.5, 2.5]
    assert T.candidate_thresholds(np.array([2.0, -1.0]), ones[:2], 5.0, 31).tolist() == [-0.5, 1.0]
    assert not len(T.candidate_thresholds(np.array([2.0]), ones[:1], 1.0, 31))


def test_leaves_of_few_rows_are_grown_in_one_pass(spark, monkeypatch):
    """The same trees however many rows a task may take, and a deep one without a pass a level."""
    rows = table(spark, *noisy(400, 4))
    params = M.TreeParams(max_depth=12, trees=2)
    found, best = [], T.Grower._best
    for most in (T.LOCAL_ROWS, 60, 0):
        passes = []
        monkeypatch.setattr(T, "LOCAL_ROWS", most)
        monkeypatch.setattr(T.Grower, "_best", lambda *a, passes=passes: passes.append(1) or best(*a))
        model = M.fit_trees(rows, params)
        said = {r["pmid"]: r["probability"][1] for r in model.transform(rows).collect()}
        found.append((len(passes), [t.numNodes for t in model.trees], model.featureImportances.toArray(), said))
    assert found[0][0] == 2 < found[1][0] <= found[2][0] and found[2][0] > 8
    for _, nodes, shares, said in found[1:]:
        assert nodes == found[0][1] and shares == pytest.approx(found[0][2]) and said == pytest.approx(found[0][3])


def test_a_vocabulary_reaches_the_jvm_in_one_call(spark, monkeypatch):
    terms = ["b", "a b", "", "\n", "ü", "z"]
    one = M.count_model(terms)
    with monkeypatch.context() as patched:
        patched.setattr(M.CountVectorizerModel, "_new_java_array", None)
        two = M.count_model(["x", "y", ""])
    rows = spark.createDataFrame([(["z", "", "b", "b", "none"],)], "tokens array<string>")
    assert one.vocabulary == terms and two.vocabulary == ["x", "y", ""]
    got = one.setInputCol("tokens").setOutputCol("n").transform(rows).first()["n"]
    assert got == Vectors.sparse(6, {0: 2.0, 2: 1.0, 5: 1.0})
    assert M.count_model(["\0\1\2\n", "a"]).vocabulary == ["\0\1\2\n", "a"]


def test_sums_do_not_grow_with_the_files(spark):
    """Each task sends sums of its own: their number hangs on the cores, and no task gets two groups of features."""
    rows = table(spark, *noisy(400, 5))
    params = M.TreeParams(max_depth=3, trees=2)
    want = M.fit_trees(rows, params).featureImportances.toArray()
    weighted = M.with_weight(rows, M.balance_factor(rows)).withColumn("margin", F.lit(0.0))
    layout = T.layout_of(weighted, "pmid", 5)
    many = materialise(T.binned(weighted, layout).repartition(60))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        assert many.rdd.getNumPartitions() == 60
        grower = T.Grower(many, layout)
        assert grower.rows.rdd.getNumPartitions() <= T.PASSES_PER_CORE * spark.sparkContext.defaultParallelism
        got = M.fit_trees(rows.repartition(60), params).featureImportances.toArray()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == pytest.approx(want)
    grower.close()


def test_many_groups_of_features(spark, monkeypatch):
    rows = table(spark, *noisy(300, 6))
    params = M.TreeParams(max_depth=3, trees=2)
    want = M.fit_trees(rows, params).featureImportances.toArray()
    asked, by_id = [], type(rows).repartitionById
    monkeypatch.setattr(type(rows), "repartitionById", lambda df, n, c: asked.append(n) or by_id(df, n, c))
    monkeypatch.setattr(T, "BLOCK_CELLS", 8)
    assert M.fit_trees(rows, params).featureImportances.toArray() == pytest.approx(want)
    assert max(asked) > 8


def test_cells_of_several_tasks_meet():
    keys = np.array([1, 4, 9, 0, 4, 9, 9])
    got = T._merged(keys, np.arange(7.0), np.ones(7))
    assert [x.tolist() for x in got] == [[0, 1, 4, 9], [3, 0, 5, 13], [1, 1, 2, 3]]
    assert [len(x) for x in T._merged(keys[:0], np.zeros(0))] == [0, 0]


@pytest.mark.parametrize("depth,rate", [(3, 1.0), (30, 1.0), (5, 0.5)])
def test_one_task_grows_the_chain_that_many_passes_grow(spark, monkeypatch, depth, rate):
    rows = table(spark, *noisy(300, 4))
    params = M.TreeParams(max_depth=depth, trees=5, feature_rate=rate)
    found, grow, passes = [], T.Grower._best, []
    monkeypatch.setattr(T.Grower, "_best", lambda self, *args: passes.append(1) or grow(self, *args))
    for most in (T.LOCAL_ENTRIES, 0):
        monkeypatch.setattr(T, "LOCAL_ENTRIES", most)
        chain = M.open_chain(rows, params)
        for upto in (3, 20, 23) if depth == 3 else (5,):  # margins are written on the way
            chain.grow(upto)
        found.append((len(chain), chain.model, len(passes)))
        chain.close()
    (n, one, none), (same, many, some) = found
    assert n == same and none == 0 < some  # no pass over the table for a tree
    assert [t.numNodes for t in one.trees] == [t.numNodes for t in many.trees]
    assert one.featureImportances.toArray() == pytest.approx(many.featureImportances.toArray(), abs=1e-9)
    said = [{r["pmid"]: r["probability"][1] for r in m.transform(rows).collect()} for m in (one, many)]
    assert said[0] == pytest.approx(said[1], abs=1e-9)
