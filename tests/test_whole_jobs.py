"""Queries that stand for a whole job run it at the settings of the whole job."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from docsieve.catalog import model_queries as Q


class Asked(Exception):
    pass


def asked(monkeypatch, module, name):
    """What a query asks of an operator; the query ends there."""

    def take(*args, **named):
        raise Asked(args, named)

    monkeypatch.setattr(module, name, take)


def settings(query, spark):
    try:
        query(spark, "")
    except Asked as found:
        return found.args
    raise AssertionError("the operator was not called")


def test_final_fit_grows_all_trees(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "_fold", lambda *a: ("train", "labels", "test", "test labels"))
    monkeypatch.setattr(Q.M, "fit_final", lambda *a: seen.append(a[-1]) or SimpleNamespace(stages=["one"]))
    assert [r["kind"] for r in Q.final_fit(spark, "").collect()] == ["str"]
    assert (seen[0].trees, seen[0].max_depth, seen[0].min_df) == (148, 4, 2)


def test_test_results_are_stored_beside_the_metrics(spark, monkeypatch, tmp_path):
    seen = []
    results = spark.createDataFrame([(1, "Relevant", "Relevant", True), (2, "Relevant", "Not Relevant", False)], "pmid int, correct_label string, prediction string, result boolean")
    monkeypatch.setattr(Q, "_fold", lambda *a: ("train", "labels", "test", "test labels"))
    monkeypatch.setattr(Q.M, "fit_final", lambda *a: seen.append(a[-1]) or "model")
    monkeypatch.setattr(Q.M, "evaluate", lambda *a: (results.orderBy("result"), "metrics"))
    monkeypatch.setattr(Q, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    assert Q.test_eval(spark, "") == "metrics" and seen[0].trees == 148
    stored = spark.read.option("header", True).csv(f"{tmp_path}/final-pipeline/test_results_per_instance")
    assert sorted((r["pmid"], r["result"]) for r in stored.collect()) == [("1", "true"), ("2", "false")]


def test_prefixes_of_all_trees(spark, monkeypatch):
    table = spark.createDataFrame([(1, "train", 1.0)], "pmid int, split string, target double")
    given = []
    monkeypatch.setattr(Q, "_encoded", lambda *a: given.append(a[-1]) or table)
    asked(monkeypatch, Q.M, "fit_trees")
    (_, params), _ = settings(Q.prefix_f1, spark)
    assert given == [params] and (params.trees, params.max_depth, params.min_df) == (2000, 4, 2)


def test_holdout_metrics_of_all_rounds(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, ["a"])], "pmid int, tokens array<string>")
    spark.createDataFrame([(1, [0.5])], "vec_id int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(Q, "labelled_bags", lambda *a: (docs, docs.select("pmid", F.lit("Relevant").alias("label"))))
    monkeypatch.setattr(Q, "materialise", lambda df, *a: df)
    asked(monkeypatch, Q.X, "repeated_holdout")
    _, named = settings(lambda spark, _: Q.holdout_metrics(spark, str(tmp_path)), spark)
    params = named["params"]
    assert named["rounds"] == 200 and (params.trees, params.patience, params.max_depth, params.min_df) == (2000, 200, 4, 2)
    assert params.use_embedding and params.use_idf


def test_grid_search_over_the_whole_grid(spark, monkeypatch):
    monkeypatch.setattr(Q, "labelled_bags", lambda *a: ("docs", "labels"))
    asked(monkeypatch, Q.X, "grid_search")
    (_, _, grid), named = settings(Q.grid, spark)
    assert grid == Q.X.DEFAULT_GRID and named["folds"] == 5 and named["params"].trees == 148
