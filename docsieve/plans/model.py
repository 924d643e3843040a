"""Feature encoding, boosted trees, early stopping on F1, and scoring."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.features import document_frequency, idf
from ..operators.metrics import binary_metrics, prf
from ..operators.rows import attach_labels, with_correct
from ..operators.splits import BASE_SEED
from ..session import discard, materialise
from .boosting import Binned, Boosting, fit_until
from .vocabulary import table_encoder

POSITIVE = "Relevant"
NEGATIVE = "Not Relevant"
MAX_DEPTH = 30  # the deepest tree Spark grows
DRIVER_TERMS = 4_000_000  # terms a count model holds on the driver; more are kept as a table
BLOCK = 512  # documents whose margins are held at once
_LEAF = re.compile(r"Predict: (\S+)")  # a leaf in the printed form of a tree

# The stored search grid and the final number of trees.
GRID_MIN_DF = (2, 4, 8, 16, 32, 64, 128, 256, 512)
GRID_DEPTH = (2, 4, 8, 16, 32, 64)
GRID_FEATURE_RATE = (1 / 3, 2 / 3, 1.0)
FINAL_TREES = 148


@dataclass(frozen=True)
class TreeParams:
    """Settings of one fit.

    Every term that reaches ``min_df`` is a feature.  ``feature_rate`` is drawn
    per tree node.
    """

    min_df: int = 2
    max_depth: int = 4
    trees: int = 2000
    learning_rate: float = 0.1
    feature_rate: float = 1.0
    patience: int = 200
    seed: int = BASE_SEED
    use_bow: bool = True
    use_embedding: bool = False
    use_idf: bool = False


def with_target(df: DataFrame, positive: str = POSITIVE, label: str = "label") -> DataFrame:
    return df.withColumn("target", (F.col(label) == positive).cast("double"))


def balance_factor(df: DataFrame) -> float:
    """Negatives per positive of a table with ``target`` (one row comes back)."""
    row = df.agg(F.count_if(F.col("target") == 0).alias("neg"), F.count_if(F.col("target") == 1).alias("pos")).first()
    if not row["pos"] or not row["neg"]:
        raise ValueError("training rows must hold both classes")
    return row["neg"] / row["pos"]


def with_weight(df: DataFrame, factor: float) -> DataFrame:
    """Positives weigh ``factor``, negatives 1."""
    return df.withColumn("weight", F.when(F.col("target") == 1, F.lit(float(factor))).otherwise(F.lit(1.0)))


def with_vector(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Array column to the vector column the assembler reads."""
    as_double = F.transform(embedding, lambda x: x.cast("double"))
    return df.withColumn("embedding_vector", array_to_vector(as_double))


def vocabulary_table(train: DataFrame, min_df: int) -> DataFrame:
    """(token, df), most frequent first."""
    return document_frequency(train, min_df=min_df).orderBy(F.desc("df"), F.asc("token"))


def collect_terms(terms: DataFrame, use_idf: bool) -> tuple[list[str], list[float] | None]:
    """Terms of a written table (token, df[, n_docs]) in vocabulary order, and their IDF where asked for."""
    weight = idf() if use_idf else F.lit(None).cast("double")
    rows = terms.orderBy(F.desc("df"), F.asc("token")).select("token", weight.alias("idf")).collect()
    return [r["token"] for r in rows], [r["idf"] for r in rows] if use_idf else None


def vector_width(df: DataFrame, embedding: str = "embedding") -> int:
    """The one width of a vector column; mixed widths are refused."""
    row = df.agg(F.min(F.size(embedding)).alias("lo"), F.max(F.size(embedding)).alias("hi")).first()
    if not row["hi"] or row["lo"] != row["hi"]:
        raise ValueError(f"vectors must share one width, found {row['lo']} to {row['hi']}")
    return row["hi"]


def count_model(vocabulary: Sequence[str]) -> CountVectorizerModel:
    """A count model of a vocabulary, which goes to the JVM as one text and not term by term."""
    terms = list(vocabulary)
    mark = next((m for m in "\n\0\1\2" if not any(t is None or m in t for t in terms)), None)
    if not terms or mark is None:
        return CountVectorizerModel.from_vocabulary(terms, inputCol="tokens")
    jvm = SparkContext._active_spark_context._jvm
    listed = jvm.java.util.regex.Pattern.compile(mark).split(mark.join(terms), -1)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", listed)
    return model._set(vocabSize=len(terms))


def encoder(
    vocabulary: Sequence[str], idf_values: Sequence[float] | None, params: TreeParams, width: int | None = None
) -> list[Transformer]:
    """Fitted stages from ``tokens`` / ``embedding_vector`` to ``features``.

    ``width`` is the vector width; stating it lets streams be assembled, too.
    """
    terms: list[Transformer] = []
    if params.use_bow:
        terms.append(count_model(vocabulary).setInputCol("tokens").setOutputCol("term_counts"))
        source = "term_counts"
        if idf_values is not None:
            terms.append(
                ElementwiseProduct(
                    scalingVec=Vectors.dense(idf_values), inputCol="term_counts", outputCol="term_idf"
                )
            )
            source = "term_idf"
        terms.append(Normalizer(p=1.0, inputCol=source, outputCol="term_weights"))
    return _assembled(terms, params, width)


def _assembled(terms: list[Transformer], params: TreeParams, width: int | None) -> list[Transformer]:
    stages, inputs = list(terms), ["term_weights"] if terms else []
    if params.use_embedding:
        stages.append(VectorSizeHint(inputCol="embedding_vector", size=width))
        inputs.append("embedding_vector")
    if not inputs:
        raise ValueError("use terms, vectors or both")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def term_encoder(
    terms: DataFrame, params: TreeParams, width: int | None = None, driver_terms: int | None = None
) -> list[Transformer] | None:
    """Stages over a written table of terms (token, df[, n_docs]); None if it is empty.

    Up to ``driver_terms`` terms make a count model, which the driver holds and which takes
    streams; a larger vocabulary stays a table that rows are joined with.  Both give the
    same vectors.
    """
    n = terms.count()
    if not n:
        return None
    if n > (DRIVER_TERMS if driver_terms is None else driver_terms):
        return _assembled([table_encoder(terms, n, params.use_idf)], params, width)
    return encoder(*collect_terms(terms, params.use_idf), params, width)


def fit_encoder(train: DataFrame, params: TreeParams, driver_terms: int | None = None) -> list[Transformer]:
    """Encoder whose vocabulary and IDF come from ``train`` only."""
    width = vector_width(train) if params.use_embedding else None
    if not params.use_bow:
        return encoder([], None, params, width)
    terms = document_frequency(train, min_df=params.min_df)
    if params.use_idf:
        terms = terms.withColumn("n_docs", F.lit(train.count()))
    terms = materialise(terms, "terms")
    stages = term_encoder(terms, params, width, driver_terms) or encoder([], [] if params.use_idf else None, params, width)
    discard(terms)
    return stages


def encode(stages: Sequence[Transformer], df: DataFrame) -> DataFrame:
    """``df`` with its ``features``, without the name of every feature, which each plan and file would carry on."""
    return PipelineModel(list(stages)).transform(df).withMetadata("features", {})


def assemble(df: DataFrame, params: TreeParams) -> DataFrame:
    """``df`` with its ``features`` vector, encoder fitted on the same rows."""
    ready = with_vector(df) if params.use_embedding else df
    return PipelineModel(fit_encoder(ready, params)).transform(ready)


def tree_classifier(params: TreeParams) -> GBTClassifier:
    rate = params.feature_rate
    if params.max_depth > MAX_DEPTH:
        raise ValueError(f"Spark grows trees of depth {MAX_DEPTH} at most, not {params.max_depth}")
    return GBTClassifier(
        featuresCol="features",
        labelCol="target",
        weightCol="weight",
        maxIter=params.trees,
        maxDepth=params.max_depth,
        stepSize=params.learning_rate,
        featureSubsetStrategy="all" if rate >= 1 else f"{rate:.4f}",
        seed=params.seed,
    )


def open_chain(train: DataFrame, params: TreeParams, start: Binned | None = None) -> Boosting:
    """A chain of class-weighted trees on encoded rows (``features``, ``target``[, ``pmid``])."""
    if params.max_depth > MAX_DEPTH:
        raise ValueError(f"trees of depth {MAX_DEPTH} at most can be stored, not {params.max_depth}")
    kept = [c for c in ("pmid", "features", "target") if c in train.columns]
    weighted = train.select(*kept) if start else with_weight(train.select(*kept), balance_factor(train))
    return Boosting(weighted, params, start=start)


def fit_trees(train: DataFrame, params: TreeParams, start: Binned | None = None) -> GBTClassificationModel:
    """Class-weighted boosted trees on encoded rows (``features``, ``target``[, ``pmid``]).

    ``start`` are the bins of these rows (``open_chain(train, params).bins()``), for fits that differ in
    depth, rate or number of trees only.
    """
    chain = open_chain(train, params, start)
    try:
        chain.grow(params.trees)
        return tree_classifier(params)._copyValues(chain.model)
    finally:
        chain.close()


# --- Tree prefixes ----------------------------------------------------------

def leaf_values(model: GBTClassificationModel, known: np.ndarray | None = None) -> np.ndarray:
    """Weighted leaf outputs, one row per tree, in the model's leaf order, padded with zeros.

    Each tree is read once, from its printed form, which lists its leaves in that order;
    ``known`` are the values of the model's first trees.
    """
    done = 0 if known is None else len(known)
    rows = [] if known is None else list(known)
    for tree, weight in zip(model.trees[done:], model.treeWeights[done:], strict=True):
        rows.append(weight * np.array([float(leaf) for leaf in _LEAF.findall(tree.toDebugString)]))
    out = np.zeros((len(rows), max(map(len, rows))))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _leaves(model: GBTClassificationModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the leaf reached in every tree: one model pass for all prefixes."""
    tagged = model.copy().setLeafCol("_leaf").transform(df)
    return tagged.select(*keep, vector_to_array("_leaf", "float32").alias("_leaf"))


def _margins(leaves: pd.Series, values: np.ndarray) -> np.ndarray:
    """Margin after 1, 2, ... trees, one row per document."""
    index = np.vstack(leaves.to_numpy()).astype(np.int64)
    return np.cumsum(values[np.arange(values.shape[0]), index], axis=1)


def prefix_scores(model: GBTClassificationModel, df: DataFrame, values: np.ndarray | None = None) -> DataFrame:
    """(iteration, tp, fp, fn, f1) for the first 1, 2, ... trees of the model.

    Each task adds up its own batches, so only one row per iteration and task
    is shuffled.
    """
    table = leaf_values(model) if values is None else values

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, table.shape[0]), dtype=np.int64)
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.iloc[start : start + BLOCK]
                said = _margins(part["_leaf"], table) > 0
                real = part["target"].to_numpy()[:, None] == 1
                total += np.stack([(said & real).sum(0), (said & ~real).sum(0), (~said & real).sum(0)])
        yield pd.DataFrame(
            {"iteration": np.arange(1, table.shape[0] + 1), "tp": total[0], "fp": total[1], "fn": total[2]}
        )

    partial = _leaves(model, df, ["target"]).mapInPandas(count, "iteration int, tp bigint, fp bigint, fn bigint")
    summed = partial.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return summed.withColumn("f1", prf()["f1"])


def prefix_predict(
    model: GBTClassificationModel,
    df: DataFrame,
    trees: int,
    keep: Sequence[str] = ("pmid", "label"),
    values: np.ndarray | None = None,
) -> DataFrame:
    """``keep`` and the prediction of the first ``trees`` trees."""
    table = (leaf_values(model) if values is None else values)[:trees]

    @F.pandas_udf(DoubleType())
    def margin(leaves: pd.Series) -> pd.Series:
        rows = leaves.to_numpy()
        blocks = (rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK))
        cut = (np.vstack(b)[:, : table.shape[0]].astype(np.int64) for b in blocks)
        sums = [table[np.arange(table.shape[0]), index].sum(axis=1) for index in cut]
        return pd.Series(np.concatenate(sums) if sums else [], dtype=float)

    said = F.when(margin("_leaf") > 0, POSITIVE).otherwise(NEGATIVE)
    return _leaves(model, df, keep).select(*keep, said.alias("prediction"))


def best_prefix(model: GBTClassificationModel, val: DataFrame, patience: int, values: np.ndarray) -> int:
    """The prefix of best validation F1 before ``patience`` trees without improvement.

    As ``best_iteration``, over the one row per tree that ``prefix_scores`` leaves.
    """
    best, highest = 0, -1.0
    for iteration, f1 in sorted((r["iteration"], r["f1"]) for r in prefix_scores(model, val, values).collect()):
        if f1 > highest:
            best, highest = iteration, f1
        elif iteration - best >= patience:
            break
    return best


def fit_stopped(
    train: DataFrame, val: DataFrame, params: TreeParams, start: Binned | None = None
) -> tuple[GBTClassificationModel, np.ndarray, int]:
    """(model, leaf values, best iteration) with early stopping on the validation F1.

    The trees grown are the best iteration and ``patience`` more (``params.trees`` at
    most), each grown once, and they are those of a single fit of as many trees.  ``start`` as in
    :func:`fit_trees`.
    """
    chain = open_chain(train, params, start)
    values = None

    def judge(model: GBTClassificationModel) -> int:
        nonlocal values  # of the model judged last, which is the final one
        values = leaf_values(model, values)
        return best_prefix(model, val, params.patience, values)

    try:
        best = fit_until(chain, judge, params.trees, params.patience)
        return chain.model, values, best
    finally:
        chain.close()


# --- Final model ------------------------------------------------------------

def fit_final(docs: DataFrame, labels: DataFrame, params: TreeParams) -> PipelineModel:
    """Encoder, trees and label names fitted on all labelled rows, as one model.

    ``docs`` holds (pmid, tokens[, embedding]).
    """
    rows = with_target(attach_labels(docs, labels))
    return fit_chain(with_vector(rows) if params.use_embedding else rows, params)


def fit_chain(rows: DataFrame, params: TreeParams) -> PipelineModel:
    """:func:`fit_final` on labelled rows (pmid, tokens, target[, embedding, embedding_vector]), read twice."""
    stages = fit_encoder(rows, params)
    encoded = materialise(encode(stages, rows).select("pmid", "features", "target"), "encoded")
    trees = fit_trees(encoded, params)
    discard(encoded)
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=[NEGATIVE, POSITIVE])
    return PipelineModel([*stages, trees, names])


def score(model: PipelineModel, docs: DataFrame, keep: Sequence[str] = ("pmid",)) -> DataFrame:
    """(keep, prediction, probability) for new documents; nothing is shuffled."""
    ready = with_vector(docs) if "embedding" in docs.columns else docs
    return model.transform(ready).select(
        *keep,
        F.col("predicted_label").alias("prediction"),
        F.get(vector_to_array("probability"), F.lit(1)).alias("probability"),
    )


def evaluate(model: PipelineModel, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-document results (wrong ones first) and one row of metrics, both of documents scored once."""
    scored = materialise(attach_labels(score(model, docs), labels), "test-scores")
    results = with_correct(scored).select(
        "pmid", F.col("label").alias("correct_label"), "prediction", (F.col("correct") == 1).alias("result")
    )
    return results.orderBy("result", "pmid"), binary_metrics(scored, [], POSITIVE)

