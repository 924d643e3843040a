"""Model invariants on a small learnable corpus."""

from dataclasses import replace

import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from docsieve.catalog import model_queries
from docsieve.operators.metrics import best_iteration
from docsieve.plans import experiment as X
from docsieve.plans import model as M
from docsieve.plans.boosting import Boosting
from docsieve.plans.vocabulary import ranked
from docsieve.session import materialise, scratch_path
from docsieve.sources import writers
from docsieve.streaming.scoring import ARRIVAL, latest_scores, score_stream

PARAMS = M.TreeParams(max_depth=2, trees=5, patience=2)


@pytest.fixture(scope="module")
def data(spark):
    """Relevant documents hold 'dose'; a few labels are wrong."""
    rows = []
    for i in range(150):
        relevant = i % 4 == 0
        tokens = [f"w{i % 11}", f"v{i % 7}"] + (["dose"] if relevant != (i % 37 == 5) else [])
        rows.append((i, tokens, [float(i % 5), float(relevant)], M.POSITIVE if relevant else M.NEGATIVE))
    df = spark.createDataFrame(rows, "pmid bigint, tokens array<string>, embedding array<double>, label string")
    df = materialise(df)
    return df.select("pmid", "tokens", "embedding"), df.select("pmid", "label")


@pytest.fixture(scope="module")
def encoded(spark, data):
    docs, labels = data
    rows = M.with_target(docs.drop("embedding").join(labels, "pmid"))
    stages = M.fit_encoder(rows, PARAMS)
    return materialise(M.PipelineModel(stages).transform(rows).select("pmid", "label", "target", "features"))


def test_prefixes_reproduce_the_model(spark, encoded):
    model = M.fit_trees(encoded, PARAMS)
    values = M.leaf_values(model)
    assert values.shape[0] == 5
    full = M.prefix_predict(model, encoded, 5, keep=["pmid"], values=values)
    own = model.transform(encoded).select("pmid", F.when(F.col("prediction") == 1, M.POSITIVE).otherwise(M.NEGATIVE).alias("own"))
    assert own.join(full, "pmid").where("own <> prediction").isEmpty()
    for r in M.prefix_scores(model, encoded, values).collect():
        said = M.prefix_predict(model, encoded, r["iteration"], values=values)
        tp = said.where(f"label = '{M.POSITIVE}' and prediction = '{M.POSITIVE}'").count()
        assert r["tp"] == tp
    # The first tree alone equals a fit of one tree.
    one = M.fit_trees(encoded, replace(PARAMS, trees=1)).transform(encoded).select("pmid", "prediction")
    first = M.prefix_predict(model, encoded, 1, keep=["pmid"], values=values).select("pmid", (F.col("prediction") == M.POSITIVE).cast("double").alias("p"))
    assert one.join(first, "pmid").where("prediction <> p").isEmpty()


def test_class_weight(encoded):
    factor = M.balance_factor(encoded)
    sums = M.with_weight(encoded, factor).groupBy("target").agg(F.sum("weight").alias("w")).collect()
    assert sums[0]["w"] == pytest.approx(sums[1]["w"])


@pytest.mark.parametrize("use_idf,use_embedding", [(False, False), (True, True)])
def test_repeated_holdout(data, use_idf, use_embedding):
    docs, labels = data
    params = replace(PARAMS, use_idf=use_idf, use_embedding=use_embedding)
    run = X.repeated_holdout(docs, labels, rounds=2, params=params, parallelism=2)
    assert run.predictions.count() == 60
    tally = run.tally.agg(F.sum("times_test").alias("t"), F.count("*").alias("n")).first()
    assert (tally["t"], tally["n"]) == (60, 150)
    metrics = run.metrics.collect()
    assert [m["tp"] + m["fp"] + m["fn"] + m["tn"] for m in metrics] == [30, 30]
    assert all(m["f1"] > 0.7 for m in metrics)
    assert all(1 <= r["best_iteration"] <= 5 for r in run.iterations.collect())


def test_vectors_only(data):
    docs, labels = data
    params = replace(PARAMS, use_bow=False, use_embedding=True)
    run = X.repeated_holdout(docs, labels, rounds=1, params=params)
    assert run.metrics.first()["f1"] == 1.0


def test_grid_search(data):
    docs, labels = data
    params = replace(PARAMS, trees=2, use_embedding=True)
    found = X.grid_search(docs, labels, {"min_df": [2, 120], "feature_rate": [1 / 3, 1.0]}, 3, params, 2)
    scores = {(r["min_df"], round(r["feature_rate"], 2)): r["mean_f1"] for r in found.scores.collect()}
    assert set(scores) == {(2, 0.33), (2, 1.0), (120, 0.33), (120, 1.0)}
    assert scores[(120, 1.0)] is None and scores[(2, 1.0)] > 0.5  # no term in 120 documents
    assert found.best.min_df == 2


@pytest.mark.parametrize("settings", [{"use_bow": False, "use_embedding": True}, {"use_idf": True}])
def test_grid_search_keeps_its_settings(data, settings):
    docs, labels = data
    docs = docs if settings.get("use_embedding") else docs.drop("embedding")
    found = X.grid_search(docs.drop("tokens") if settings.get("use_embedding") else docs, labels, {"min_df": [2], "max_depth": [64, 2]}, 2, replace(PARAMS, trees=1, **settings), 2)
    scores = [(r["max_depth"], r["fitted_depth"]) for r in found.scores.orderBy("param_order").collect()]
    assert scores == [(64, 30), (2, 2)]
    kinds = [type(s).__name__ for s in found.model.stages]
    assert kinds[-1] == "IndexToString" and ("ElementwiseProduct" in kinds) == settings.get("use_idf", False)
    assert M.score(found.model, docs).count() == 150


def test_default_grid_has_a_row_for_every_set():
    grid = X.DEFAULT_GRID
    assert len(grid["min_df"]) * len(grid["max_depth"]) * len(grid["feature_rate"]) == 162
    with pytest.raises(ValueError, match="depth"):
        M.tree_classifier(replace(PARAMS, max_depth=31))


def plain_best(errors, patience):
    """The last strict improvement before ``patience`` values without one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


@pytest.mark.parametrize("patience", [1, 2, 5])
def test_patience_ends_the_fit(spark, encoded, patience):
    val = encoded.where("pmid % 3 = 0")
    params = replace(PARAMS, trees=40, patience=patience)
    model, values, best = M.fit_stopped(encoded, val, params)
    # No tree beyond the stopping point and patience, and none grown twice.
    assert len(model.trees) == best + patience < 40 and values.shape[0] == len(model.trees)
    scores = M.prefix_scores(M.fit_trees(encoded, params), val).orderBy("iteration").collect()
    assert best == plain_best([1 - r["f1"] for r in scores], patience)


@pytest.mark.parametrize("steps", [[1, 2, 3, 7], [7], [5, 7]])
def test_a_chain_goes_on_as_if_fitted_at_once(encoded, steps):
    params = replace(PARAMS, trees=7, feature_rate=1.0)
    whole = M.fit_trees(encoded, params)
    chain = Boosting(
        M.with_weight(encoded, M.balance_factor(encoded)), params,
        lambda rows, n: M.tree_classifier(replace(params, trees=n)).fit(rows),
    )
    for upto in steps:
        chain.grow(upto)
        assert len(chain) == upto == len(chain.model.trees)
    said = {r["pmid"]: r["probability"][1] for r in chain.model.transform(encoded).collect()}
    for r in whole.transform(encoded).collect():
        assert said[r["pmid"]] == pytest.approx(r["probability"][1], abs=1e-9)
    # The written margin is the model's.
    margins = sorted(r["margin"] for r in chain.now.collect())
    own = sorted(r["rawPrediction"][1] for r in chain.model.transform(encoded).collect())
    assert margins == pytest.approx(own)
    chain.close()


def test_fit_stops_at_the_most_trees(encoded):
    model, _, best = M.fit_stopped(encoded, encoded.where("pmid % 3 = 0"), replace(PARAMS, trees=3, patience=50))
    assert len(model.trees) == 3 and 1 <= best <= 3


@pytest.mark.parametrize("use_idf", [False, True])
def test_a_vocabulary_beyond_the_driver(spark, data, use_idf):
    docs, labels = data
    rows = M.with_target(docs.drop("embedding").join(labels, "pmid"))
    odd = spark.createDataFrame([(900, [], "x", 0.0), (901, ["unknown"], "x", 0.0)], "pmid bigint, tokens array<string>, label string, target double")
    params = replace(PARAMS, use_idf=use_idf)
    small = M.fit_encoder(rows, params)
    large = M.fit_encoder(rows, params, driver_terms=3)
    assert type(large[0]).__name__ == "TermEncoder" and large[0].getOrDefault("size") == len(small[0].vocabulary) > 3
    table = spark.read.parquet(large[0].getOrDefault("table")).orderBy("place").collect()
    assert [r["token"] for r in table] == small[0].vocabulary and [r["place"] for r in table] == list(range(len(table)))
    both = rows.select(*odd.columns).unionByName(odd)
    path = scratch_path(spark, "encoder")
    writers.save_model(M.PipelineModel(large), path)
    for stages in (large, writers.load_model(spark, path).stages):
        want = {r["pmid"]: r["features"].toArray() for r in M.PipelineModel(small).transform(both).collect()}
        got = M.PipelineModel(stages).transform(both).collect()
        assert len(got) == 152
        for r in got:
            assert r["features"].toArray() == pytest.approx(want[r["pmid"]])


def test_ranks_of_many_partitions(spark):
    terms = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("token"), (F.col("id") % 17).alias("df"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(terms).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((-(i % 17), f"t{i}") for i in range(5000))
    assert [(r["token"], r["place"]) for r in got] == [(t, i) for i, (_, t) in enumerate(want)]


def test_a_large_vocabulary_is_used_throughout(data, monkeypatch):
    docs, labels = data
    monkeypatch.setattr(M, "DRIVER_TERMS", 3)
    run = X.repeated_holdout(docs, labels, rounds=1, params=replace(PARAMS, use_embedding=True))
    assert run.metrics.first()["f1"] > 0.7
    model = M.fit_final(docs.drop("embedding"), labels, PARAMS)
    assert type(model.stages[0]).__name__ == "TermEncoder" and M.score(model, docs.drop("embedding")).count() == 150


def test_final_model_save_load_stream(spark, data):
    docs, labels = data
    params = replace(PARAMS, use_embedding=True, use_idf=True)
    model = M.fit_final(docs, labels, params)
    results, metrics = M.evaluate(model, docs, labels)
    m = metrics.first()
    assert m["tp"] + m["tn"] == results.where("result").count() and m["accuracy"] > 0.9
    flags = [r["result"] for r in results.collect()]
    assert flags == sorted(flags)

    path = scratch_path(spark, "model")
    writers.save_model(model, path)
    again = writers.load_model(spark, path)
    batch = {r["pmid"]: r["probability"] for r in M.score(again, docs).collect()}

    source, sink, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    docs.repartition(3).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        score_stream(again, spark, source, docs.schema, sink, checkpoint).awaitTermination()
    rows = spark.read.parquet(sink)
    assert rows.count() == 150 and set(ARRIVAL) <= set(rows.columns)
    # One document arrives again with other content: its newest score counts.
    other = docs.where("pmid = 4").withColumn("tokens", F.array(F.lit("w1")))
    other.write.mode("append").parquet(source)
    score_stream(again, spark, source, docs.schema, sink, checkpoint).awaitTermination()
    expected = {**batch, 4: M.score(again, other).first()["probability"]}
    got = {r["pmid"]: r["probability"] for r in latest_scores(spark, sink).collect()}
    assert got == pytest.approx(expected)


def test_early_stop_uses_first_of_equal_scores(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.4), (0, 4, 0.4)], "round int, iteration int, err double")
    assert best_iteration(df, 10).first()["best_iteration"] == 3


def test_encoded_rows_do_not_carry_every_feature_name(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"])], "pmid int, tokens array<string>")
    params = M.TreeParams(min_df=1)
    stages = M.fit_encoder(rows, params)
    got = M.encode(stages, rows)
    assert not got.schema["features"].metadata
    assert got.select("features").collect() == M.assemble(rows, params).select("features").collect()


def test_fits_of_a_grid_share_their_bins(data, monkeypatch):
    docs, labels = data
    made, bins = [], Boosting.bins
    monkeypatch.setattr(Boosting, "bins", lambda self: made.append(len(self)) or bins(self))
    grid = {"min_df": [2], "max_depth": [2, 1], "feature_rate": [0.5, 1.0]}
    found = X.grid_search(docs.drop("embedding"), labels, grid, 2, replace(PARAMS, trees=2), 2)
    assert len(made) == 2 + 1  # one a fold, not one a fit, and the final fit's
    assert found.scores.where("mean_f1 BETWEEN 0 AND 1").count() == 4


def test_the_two_fits_of_an_early_stop_share_their_bins(spark, monkeypatch):
    rows = [(i, "train" if i % 3 else "val", float(i % 4 == 0), Vectors.dense([float(i % 4 == 0), i % 5 / 5])) for i in range(90)]
    schema = StructType([StructField("pmid", IntegerType()), StructField("split", StringType()), StructField("target", DoubleType()), StructField("features", VectorUDT())])
    table = materialise(spark.createDataFrame(rows, schema))
    made, bins = [], Boosting.bins
    monkeypatch.setattr(model_queries, "_encoded", lambda *a: table)
    monkeypatch.setattr(Boosting, "bins", lambda self: made.append(len(self)) or bins(self))
    row = model_queries.early_stop(spark, "").first()
    assert len(made) == 1 and row["few_trees"] and row["same_as_full_fit"] and row["stopped_inside"]
