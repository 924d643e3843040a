"""Boosted trees that can go on: early stopping without fitting anything twice.

A boosted fit is a chain of regression trees, each on the gradient that the margin so far
leaves; here the chain is kept open.  Its trees are grown over binned sparse rows
(:mod:`.trees`), with the seed the whole fit would have used.  So a chain of n trees is the
same however it was grown.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise
from .trees import CHAIN_TREES, FEW_TREES, Grower, Layout, Tree, binned, is_local, layout_of

#: Trees after which the margins are written; tasks work out those of the trees since.
WRITE_EVERY = 16


def gradient(y: Column, margin: Column) -> Column:
    """What is left of a label of -1 or 1 at a margin: minus the slope of 2 log(1 + exp(-2 y F))."""
    return 4 * y / (1 + F.exp(2 * y * margin))


def as_model(spark: SparkSession, trees: list, weights: list[float], n_features: int = -1) -> GBTClassificationModel:
    """The fitted regression trees as one boosted classifier."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    packages = jvm.org.apache.spark.ml
    kind = packages.regression.DecisionTreeRegressionModel
    parts = gateway.new_array(kind, len(trees))
    shares = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        parts[i], shares[i] = tree, float(weight)
    java = packages.classification.GBTClassificationModel(f"boosted_{trees[0].uid()}_{len(trees)}", parts, shares, n_features, 2)
    return GBTClassificationModel(java).setFeaturesCol("features")


def as_tree(spark: SparkSession, tree: Tree, layout: Layout, name: str):
    """A grown tree as Spark's model of it."""
    jvm = spark.sparkContext._jvm
    packages = jvm.org.apache.spark.ml
    # Every name looked up and every number set is a call: names are looked up once, numbers go over together.
    leaf, inner, continuous = packages.tree.LeafNode, packages.tree.InternalNode, packages.tree.ContinuousSplit
    calculator, part = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.java.util.Arrays.copyOfRange
    sums = np.array(tree.sums)
    stats = _py2java(spark.sparkContext, Vectors.dense(sums[:, 1:].ravel())).toArray()
    nodes: list = [None] * len(sums)
    for i in reversed(range(len(nodes))):  # children come after their parent
        n, weight, total, squares = map(float, sums[i])
        own = calculator(part(stats, 3 * i, 3 * i + 3), int(n))
        said = total / weight if weight else 0.0
        impurity = max(squares / weight - said * said, 0.0) if weight else 0.0
        if tree.feature[i] < 0:
            nodes[i] = leaf(said, impurity, own)
            continue
        split = continuous(tree.feature[i], layout.threshold(tree.cut[i], tree.feature[i]))
        nodes[i] = inner(said, impurity, tree.gain[i], nodes[tree.left[i]], nodes[tree.right[i]], split, own)
        nodes[tree.left[i]] = nodes[tree.right[i]] = None
    return packages.regression.DecisionTreeRegressionModel(name, nodes[0], layout.n_features)


class Binned(NamedTuple):
    """Written rows that chains start from: the bins of their entries, their margin zero."""

    layout: Layout
    table: DataFrame
    local: bool  # whether one task holds all rows


def bin_rows(rows: DataFrame, key: str, seed: int) -> Binned:
    """Weighted rows (``features``, ``target``, ``weight``, ``margin``, ``key``), written as bins."""
    layout = layout_of(rows, key, seed)
    table = materialise(binned(rows, layout), "margins")
    return Binned(layout, table, is_local(table))


class Boosting:
    """A chain of trees over weighted training rows (``features``, ``target``, ``weight``[, ``pmid``]).

    The rows are written once, as bins of their entries, and their margin with them: a lost
    executor costs a task, and neither the trees nor the plan behind the rows are ever
    computed again.  Few rows go to one task, which grows tree after tree; more are grown level by
    level over the table, to the same trees.  ``first``, where given, grows the first trees of a chain in one fit.
    Chains of one seed over the same rows may share their bins (``start``), which then outlive the chain.
    """

    def __init__(
        self,
        rows: DataFrame,
        params,
        first: Callable[[DataFrame, int], GBTClassificationModel] | None = None,
        start: Binned | None = None,
    ):
        self.spark, self.params, self.first, self.start = rows.sparkSession, params, first, start
        self.key = "pmid" if "pmid" in rows.columns else "features"
        self.rows = rows.withColumn("margin", F.lit(0.0))
        self.layout: Layout | None = None
        self.written: DataFrame | None = None
        self.grower: Grower | None = None
        self.local = False  # whether one task holds all rows
        self.since: list = []  # trees whose margins are not written
        self.trees: list = []
        self.weights: list[float] = []
        self._model: GBTClassificationModel | None = None

    def __len__(self) -> int:
        return len(self.trees)

    def grow(self, upto: int) -> None:
        """Go on until the chain has ``upto`` trees."""
        if upto <= len(self):
            return
        self._model = None
        if self.first and not self.trees:
            self._start(upto)
        while len(self) < upto:
            self._add(upto)

    def _start(self, trees: int) -> None:
        model = self.first(self.rows, trees)
        self.trees = list(model._java_obj.trees())
        self.weights = list(model.treeWeights)
        # The raw score of a class is half its margin either way.
        margin = vector_to_array(F.col("raw"))[1]
        scored = model.copy().setRawPredictionCol("raw").transform(self.rows)
        self.rows = scored.select(*(c for c in self.rows.columns if c != "margin"), margin.alias("margin"))

    def bins(self) -> Binned:
        """The rows as a chain starts from them, written."""
        return bin_rows(self.rows, self.key, self.params.seed)

    def _add(self, upto: int) -> None:
        """One more tree; of few rows as many as one task grows, up to ``upto``."""
        params, n = self.params, len(self)
        if self.grower is None:
            found = self.start or self.bins()
            self.layout, self.local = found.layout, found.local
            self.written = None if self.start else found.table
            self.grower = Grower(found.table, found.layout)
        elif len(self.since) >= WRITE_EVERY:
            self._write(self.now)
        if self.local and upto - n > FEW_TREES:
            grown = self.grower.chain(
                self.since, n, min(upto, n + CHAIN_TREES), params.max_depth, params.feature_rate, params.seed, params.learning_rate
            )
        else:
            grown = [self.grower.grow(self.since, n == 0, params.max_depth, params.feature_rate, params.seed + n)]
        for tree in grown:
            n = len(self)
            self.trees.append(as_tree(self.spark, tree, self.layout, f"tree_{params.seed}_{n}"))
            self.weights.append(1.0 if n == 0 else params.learning_rate)
            self.since.append((self.weights[-1], tree.walk()))

    @property
    def now(self) -> DataFrame:
        """The rows and their margin after the trees so far."""
        return self.rows if self.grower is None else self.grower.with_margin(self.since)

    def _write(self, rows: DataFrame) -> None:
        table = materialise(rows, "margins")
        self.close()
        self.written, self.since = table, []
        self.grower = Grower(table, self.layout)

    @property
    def model(self) -> GBTClassificationModel:
        if self._model is None:
            n_features = -1 if self.layout is None else self.layout.n_features
            self._model = as_model(self.spark, self.trees, self.weights, n_features)
        return self._model

    def close(self) -> None:
        """Delete the written rows; the trees stay."""
        if self.grower is not None:
            self.grower.close()
        if self.written is not None:
            discard(self.written)


def fit_until(
    chain: Boosting, judge: Callable[[GBTClassificationModel], int], trees: int, patience: int
) -> int:
    """Grow ``chain`` until ``patience`` trees follow the best one, or to ``trees``; returns the best.

    ``judge`` gives the best prefix of a model.  A chain cannot end before ``patience``
    trees follow the best prefix known, so it is judged only there: the trees grown are
    exactly the stopping point and ``patience`` more.
    """
    best = 1
    while True:
        chain.grow(min(trees, best + patience))
        best = judge(chain.model)
        if len(chain) >= min(trees, best + patience):
            return best

