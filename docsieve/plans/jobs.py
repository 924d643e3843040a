"""The jobs a user runs, from stored inputs to stored outputs.

Each is a thin order of steps over the operators; heavy work stays in their
plans.  Runs and experiments are configuration, a handful of names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import concat_vectors, slice_vector
from ..functions.naming import RESULT_PREFIX
from ..functions.text import SEPARATOR, split_tokens
from ..operators.checks import fingerprint_of, multiset_fingerprint, require_same_keys
from ..operators.metrics import class_share, fill_rate
from ..operators.pooling import pool_vectors, token_vectors
from ..operators.report import boxplot_table, interval_summary, leaderboard
from ..operators.rows import normalise, select_labelled
from ..sources import manifest, readers, writers
from .chain import Preprocessor, takes_raw_documents, with_preprocessor
from .experiment import Experiment, Search, grid_search, repeated_holdout
from .model import FINAL_TREES, TreeParams, evaluate, fit_final, score
from .preprocess import FIELD_RUNS, OPTIMAL, POOLING_RUNS, Runs, field_tokens, preprocess, run_fields, run_matrix

# The fields whose fill rates are reported.
PROFILE_FIELDS = (
    "title", "abstract", "author", "journal", "keywords", "chemical_list", "mesh_terms",
    "publication_types", "affiliation",
)


def subset_job(spark: SparkSession, corpus: str, labels: str, out: str) -> None:
    """Labelled rows of the corpus, as Parquet."""
    writers.write_parquet(select_labelled(readers.read_corpus(spark, corpus), readers.read_labels(spark, labels)), out)


def profile_job(spark: SparkSession, subset: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """Class shares of the labels and fill rates of the fields."""
    docs = readers.read_corpus(spark, subset)
    present = [f for f in PROFILE_FIELDS if f in docs.columns]
    return class_share(readers.read_labels(spark, labels)), fill_rate(docs, present)


def _pending(spark: SparkSession, out: str, keys: Mapping[str, str], overwrite: bool) -> tuple[list[str], list[str]]:
    """(runs to do, runs whose stored output is that of these keys), in the caller's order."""
    done = manifest.finished(spark, out, keys)
    matrix = spark.createDataFrame([(n,) for n in keys], "run string")
    ready = spark.createDataFrame([(n,) for n in done], "run string")
    left = {r["run"] for r in writers.pending_runs(matrix, ready, overwrite).collect()}
    return [n for n in keys if n in left], done


def _stated(options: Mapping) -> dict:
    """Options as settings of a key: a table counts by its content."""
    return {k: multiset_fingerprint(v) if isinstance(v, DataFrame) else v for k, v in options.items()}


def feature_job(
    spark: SparkSession, subset: str, out: str, runs: Runs = FIELD_RUNS, overwrite: bool = False, **options
) -> list[str]:
    """Token bags of every pending run below ``out/run=<name>``; returns their names.

    Fields are cleaned once for all runs.  ``options`` go to the preprocessing
    (stop words, lexicon, mode).  A run is pending unless its finished output was made
    with the same settings of the same content.
    """
    docs = readers.read_corpus(spark, subset)
    # One scan for what all runs read.
    content = docs.agg(*[fingerprint_of("pmid", *fields).alias(n) for n, (fields, _) in runs.items()]).first()
    settings = _stated(options)
    keys = {n: manifest.run_key({"fields": list(fields), "ngram": g, **settings}, [content[n]]) for n, (fields, g) in runs.items()}
    names, _ = _pending(spark, out, keys, overwrite)
    if names:
        todo = {n: runs[n] for n in names}
        for n in names:
            manifest.begin(spark, out, n)
        bags = run_matrix(field_tokens(docs, run_fields(todo), **options), todo)
        (
            bags.select("run", "pmid", F.array_join("tokens", SEPARATOR).alias("bow"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run")
            .parquet(out)
        )
        for n in names:
            manifest.commit(spark, out, n, keys[n])
    return names


def read_features(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(pmid, tokens) of one stored run; only its folder is read."""
    stored = spark.read.parquet(path).where(F.col("run") == run)
    tokens = F.when(F.col("bow") == "", F.array().cast("array<string>")).otherwise(split_tokens("bow"))
    return stored.select("pmid", tokens.alias("tokens"))


def vector_features(tokens: DataFrame, maxmin: bool = False, n: int = 4) -> DataFrame:
    """(pmid, abstracts_embedded, titles_embedded) from a table of sentences (pmid,
    part, sentence, layers), part being ``abstract`` or ``title`` and layers the
    sentence's tokens x layers x width."""
    summed = token_vectors(tokens, n, keep=["pmid", "part"])
    pooled = pool_vectors(summed, ["pmid", "part"], "vec", maxmin)
    return pooled.groupBy("pmid").agg(
        F.first(F.when(F.col("part") == "abstract", F.col("pooled")), ignorenulls=True).alias("abstracts_embedded"),
        F.first(F.when(F.col("part") == "title", F.col("pooled")), ignorenulls=True).alias("titles_embedded"),
    )


def vector_job(
    spark: SparkSession, tokens: str, out: str, width: int, runs: Mapping[str, bool] = POOLING_RUNS,
    overwrite: bool = False,
) -> list[str]:
    """Pooled vectors of every pending run below ``out/run=<name>``; returns their names.

    ``runs`` tells whether max and min are added.  Once a run with them is
    stored, a mean-only run is cut from it instead of pooling again.
    """
    content = multiset_fingerprint(spark.read.parquet(tokens))
    keys = {n: manifest.run_key({"maxmin": runs[n], "width": width}, [content]) for n in runs}
    names, done = _pending(spark, out, keys, overwrite)
    for name in sorted(names, key=lambda n: not runs[n]):
        whole = [n for n in runs if runs[n] and n != name and (n in done or n in names)]
        if not runs[name] and whole:
            vectors = mean_only(spark.read.parquet(f"{out}/run={whole[0]}"), width)
        else:
            vectors = vector_features(spark.read.parquet(tokens), runs[name])
        manifest.begin(spark, out, name)
        writers.write_parquet(vectors, f"{out}/run={name}")
        manifest.commit(spark, out, name, keys[name])
    return names


def mean_only(vectors: DataFrame, width: int) -> DataFrame:
    """The mean part of vectors stored as mean, max and min."""
    return vectors.withColumns(
        {c: slice_vector(c, width) for c in ("abstracts_embedded", "titles_embedded")}
    )


def joined_vectors(vectors: DataFrame) -> DataFrame:
    """(pmid, embedding): abstract part, then title part."""
    return vectors.select("pmid", concat_vectors("abstracts_embedded", "titles_embedded").alias("embedding"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, embedding) of stored vectors: JSON lines, a table of whole vectors, or one of
    abstract and title parts."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        return readers.read_embeddings_jsonl(spark, path)
    stored = spark.read.parquet(path)
    return stored.select("pmid", "embedding") if "embedding" in stored.columns else joined_vectors(stored)


def vector_evaluation_job(
    spark: SparkSession,
    vectors: Mapping[str, str],
    labels: DataFrame,
    results: str,
    tallies: str,
    bow: DataFrame | None = None,
    params: TreeParams = TreeParams(),
    **options,
) -> dict[str, Experiment]:
    """Repeated hold-out of stored vectors, alone or beside the token bag ``bow``; an
    experiment with a bag ends in ``_bow``.  ``options`` go to ``evaluation_job``."""
    read = {name: read_vectors(spark, path) for name, path in vectors.items()}
    if bow is not None:
        read = {f"{name}_bow": attach_vectors(bow, table) for name, table in read.items()}
    settings = replace(params, use_bow=bow is not None, use_embedding=True)
    return evaluation_job(read, labels, results, tallies, params=settings, **options)


def attach_vectors(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents with their vector; both sides must hold the same keys."""
    require_same_keys(docs, vectors)
    return docs.join(vectors, "pmid")


def evaluation_job(
    features: Mapping[str, DataFrame],
    labels: DataFrame,
    results: str,
    tallies: str,
    rounds: int = 200,
    size: float = 0.2,
    params: TreeParams = TreeParams(),
    overwrite: bool = False,
    parallelism: int = 4,
) -> dict[str, Experiment]:
    """Repeated hold-out of every experiment without a stored result of the same content and
    settings; writes its round metrics and its per-document tally (hardest first)."""
    spark = labels.sparkSession
    known = multiset_fingerprint(labels, "pmid", "label")
    settings = {"rounds": rounds, "size": size, "params": asdict(params)}
    keys = {n: manifest.run_key(settings, [known, multiset_fingerprint(df)]) for n, df in features.items()}
    out = {}
    for name in _pending(spark, results, keys, overwrite)[0]:
        manifest.begin(spark, results, name)
        run = repeated_holdout(features[name], labels, rounds, size, params, parallelism)
        writers.write_csv(run.tally.orderBy(F.asc_nulls_last("pct"), "pmid"), f"{tallies}/bootstrap_{name}")
        writers.write_results(run.metrics, results, f"{RESULT_PREFIX}{name}")
        manifest.commit(spark, results, name, keys[name])
        out[name] = run
    return out


def report_job(spark: SparkSession, results: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Leaderboard (written as CSV) and box-plot table of all stored results."""
    metrics = readers.read_results(spark, f"{results}/{RESULT_PREFIX}*.csv")
    board = leaderboard(interval_summary(metrics))
    writers.write_csv(board.coalesce(1), f"{out}/all_results")
    return board, boxplot_table(metrics)


def search_job(docs: DataFrame, labels: DataFrame, out: str, **options) -> Search:
    """Grid search; scores and the refitted best chain are stored."""
    found = grid_search(docs, labels, **options)
    writers.write_parquet(found.scores, f"{out}/cv_results")
    writers.save_model(found.model, f"{out}/cv_optimal_model")
    return found


def final_job(
    docs: DataFrame,
    labels: DataFrame,
    test_docs: DataFrame,
    test_labels: DataFrame,
    best: TreeParams,
    out: str,
    trees: int = FINAL_TREES,
    first_stage: Preprocessor | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Final fit with the chosen settings and a fixed number of trees, stored,
    and its test results; returns the model and one row of metrics.

    With ``first_stage``, the way ``docs`` were preprocessed, the stored model
    takes raw documents.
    """
    model = fit_final(docs, labels, replace(best, trees=trees))
    writers.save_model(with_preprocessor(model, first_stage) if first_stage else model, f"{out}/optimal_model")
    results, metrics = evaluate(model, test_docs, test_labels)
    writers.write_csv(results, f"{out}/test_results_per_instance")
    return model, metrics


def score_job(
    spark: SparkSession,
    model: str,
    path: str,
    stop_words: Sequence[str] = (),
    lexicon: Sequence[str] | DataFrame = (),
    vectors: str | None = None,
) -> DataFrame:
    """Label new documents of a CSV with a stored model on the optimal fields.

    Stop words and lexicon count only for a model without its own first stage.  A
    model of terms and vectors also takes the documents' stored ``vectors``.
    """
    filled = {"pmid": 0, **{f: "" for f in OPTIMAL}}
    docs = normalise(readers.read_documents_csv(spark, path), filled)
    stored = writers.load_model(spark, model)
    if not takes_raw_documents(stored):
        docs = preprocess(docs, OPTIMAL, 1, stop_words, lexicon)
    return score(stored, docs if vectors is None else attach_vectors(docs, read_vectors(spark, vectors)))
