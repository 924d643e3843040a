"""The stored-input jobs, end to end on a small corpus."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.plans import jobs as J
from docsieve.plans.chain import Preprocessor
from docsieve.plans.model import NEGATIVE, POSITIVE, TreeParams
from docsieve.session import scratch_path
from docsieve.sources import readers, writers
from docsieve.streaming.scoring import latest_scores, score_stream

PARAMS = TreeParams(max_depth=2, trees=3, patience=2)
RUNS = {"title": (("title",), 1), "optimal": (("title", "abstract", "mesh_terms", "publication_types"), 2)}


@pytest.fixture(scope="module")
def stored(spark):
    """Corpus of 120 rows, 80 of them labelled; relevant ones speak of clearance."""
    docs = [
        (i, f"Study {i % 9}", "Clearance was measured." if i % 3 == 0 else "Nothing of note.", "A; B", "Review", "src")
        for i in range(120)
    ]
    base = scratch_path(spark, "jobs")
    df = spark.createDataFrame(
        docs, "pmid bigint, title string, abstract string, mesh_terms string, publication_types string, journal string"
    )
    writers.write_parquet(df.withColumn("pmid", F.col("pmid").cast("string")), f"{base}/corpus")
    rows = [(i, i, "dev", POSITIVE if i % 3 == 0 else NEGATIVE) for i in range(80)]
    labels = spark.createDataFrame(rows, "ID bigint, pmid bigint, Dataset string, label string")
    writers.write_csv(labels, f"{base}/labels")
    return base


def test_jobs_end_to_end(spark, stored):
    J.subset_job(spark, f"{stored}/corpus", f"{stored}/labels", f"{stored}/subset")
    assert readers.read_corpus(spark, f"{stored}/subset").count() == 80
    shares, fills = J.profile_job(spark, f"{stored}/subset", f"{stored}/labels")
    assert shares.count() == 2 and {r["field"]: r["pct"] for r in fills.collect()}["abstract"] == 100.0

    assert J.feature_job(spark, f"{stored}/subset", f"{stored}/bow", {"title": RUNS["title"]}) == ["title"]
    assert J.feature_job(spark, f"{stored}/subset", f"{stored}/bow", RUNS) == ["optimal"]
    assert J.feature_job(spark, f"{stored}/subset", f"{stored}/bow", RUNS) == []
    features = {n: J.read_features(spark, f"{stored}/bow", n) for n in RUNS}
    assert all(f.count() == 80 for f in features.values())
    assert "noth of" in features["optimal"].where("pmid = 1").first()["tokens"]

    labels = readers.read_labels(spark, f"{stored}/labels").select("pmid", "label")
    args = (labels, f"{stored}/results", f"{stored}/tallies", 2, 0.2, PARAMS)
    assert set(J.evaluation_job(features, *args)) == {"title", "optimal"}
    assert J.evaluation_job(features, *args) == {}
    board, box = J.report_job(spark, f"{stored}/results", f"{stored}/report")
    assert [r["experiment"] for r in board.collect()] == ["res_optimal", "res_title"]
    assert {r["experiment"] for r in box.collect()} == {"Title", "Opt. Fields"}
    tally = spark.read.option("header", True).csv(f"{stored}/tallies/bootstrap_optimal")
    assert tally.count() == 80

    found = J.search_job(
        features["optimal"], labels, f"{stored}/cv", grid={"min_df": [2]}, folds=2, params=replace(PARAMS, trees=2)
    )
    assert found.best.min_df == 2
    test = features["optimal"].where("pmid < 40")
    _, metrics = J.final_job(
        features["optimal"], labels, test, labels.where("pmid < 40"), found.best, f"{stored}/final", trees=2,
        first_stage=Preprocessor(fields=list(RUNS["optimal"][0]), ngram=2),
    )
    assert metrics.first()["f1"] == 1.0
    corpus = readers.read_corpus(spark, f"{stored}/corpus")
    wanted = ["abstract", "mesh_terms", "publication_types", "title", "pmid"]
    writers.write_csv(corpus.where("pmid >= 80").select(*wanted), f"{stored}/new")
    scored = J.score_job(spark, f"{stored}/final/optimal_model", f"{stored}/new")
    right = scored.where((F.col("prediction") == POSITIVE) == (F.col("pmid") % 3 == 0))
    assert scored.count() == right.count() == 40


def test_vector_jobs(spark, stored):
    labels = readers.read_labels(spark, f"{stored}/labels").select("pmid", "label")
    ids = spark.range(80).select(F.col("id").alias("pmid"))
    parts = ids.select(
        "pmid", F.array((F.col("pmid") % 3 == 0).cast("double"), F.lit(1.0)).alias("abstracts_embedded"),
        F.array((F.col("pmid") % 5).cast("double")).alias("titles_embedded"),
    )
    writers.write_parquet(parts, f"{stored}/parts")
    lines = ids.select(F.to_json(F.struct(F.col("pmid").cast("string").alias("paper_id"), F.array(F.lit(1.0), (F.col("pmid") % 3 == 0).cast("double")).alias("embedding"))).alias("value"))
    lines.union(spark.createDataFrame([('{"paper_id": "7", "embe',), ('{"paper_id": "8", "embedding": "none"}',)], "value string")).write.text(f"{stored}/vectors.jsonl")
    read = readers.read_embeddings_jsonl(spark, f"{stored}/vectors.jsonl")
    assert read.count() == len(read.collect()) == read.select("pmid").count() == len(read.select("pmid").collect()) == 80
    bow = ids.select("pmid", F.array(F.lit("a"), F.concat(F.lit("b"), F.col("pmid") % 4)).alias("tokens"))
    both = {"parts": f"{stored}/parts", "lines": f"{stored}/vectors.jsonl"}
    where = (labels, f"{stored}/v-results", f"{stored}/v-tallies")
    found = J.vector_evaluation_job(spark, both, *where, bow=bow, params=PARAMS, rounds=1)
    assert set(found) == {"parts_bow", "lines_bow"} and found["lines_bow"].metrics.first()["f1"] == 1.0
    alone = J.vector_evaluation_job(spark, {"lines": both["lines"]}, *where, params=PARAMS, rounds=1)
    assert set(alone) == {"lines"} and alone["lines"].metrics.first()["f1"] == 1.0

    # A stored model of terms and vectors scores raw documents with their vectors, in batch and as a stream.
    docs = J.attach_vectors(bow, J.read_vectors(spark, both["parts"]))
    J.final_job(docs, labels, docs, labels, replace(PARAMS, use_embedding=True), f"{stored}/v-final", trees=2,
                first_stage=Preprocessor(fields=["title", "abstract"]))
    corpus = readers.read_corpus(spark, f"{stored}/corpus").where("pmid < 80")
    wanted = ["abstract", "mesh_terms", "publication_types", "title", "pmid"]
    writers.write_csv(corpus.select(*wanted), f"{stored}/v-new")
    scored = J.score_job(spark, f"{stored}/v-final/optimal_model", f"{stored}/v-new", vectors=both["parts"])
    assert scored.count() == 80 and scored.where((F.col("prediction") == POSITIVE) == (F.col("pmid") % 3 == 0)).count() == 80
    model = writers.load_model(spark, f"{stored}/v-final/optimal_model")
    writers.write_parquet(corpus, f"{stored}/v-stream")
    source = spark.read.parquet(f"{stored}/v-stream")
    query = score_stream(model, spark, f"{stored}/v-stream", source.schema, f"{stored}/v-out", f"{stored}/v-cp", vectors=J.read_vectors(spark, both["parts"]))
    query.awaitTermination()
    streamed = {r["pmid"]: r["probability"] for r in latest_scores(spark, f"{stored}/v-out").collect()}
    assert streamed == {r["pmid"]: r["probability"] for r in scored.collect()}


def test_lexicon_table_equals_list(spark):
    from docsieve.plans.preprocess import preprocess

    df = spark.createDataFrame(
        [(1, "Oral Dosing of ASPIRIN", "aspirin3 levels rose.", "A;B"), (2, None, "", None), (None, "aspirin", "DRUGNAME", "")],
        "pmid bigint, title string, abstract string, mesh_terms string",
    )
    words = ["aspirin", "levels"]
    table = spark.createDataFrame([(w,) for w in (*words, "Levels", None)], "token string")
    fields = ["title", "abstract", "mesh_terms"]
    want, got = (preprocess(df, fields, 2, ["oral"], lexicon) for lexicon in (words, table))
    assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))


def test_preprocessor_equals_function(spark):
    from docsieve.plans.preprocess import preprocess

    df = spark.createDataFrame(
        [(1, "Oral dosing", "Levels rose.", 7), (2, None, "", 8)], "pmid bigint, title string, abstract string, extra int"
    )
    stage = Preprocessor(fields=["title", "abstract"], ngram=2, stopWords=["oral"], lexicon=["levels"])
    out = stage.transform(df)
    assert out.columns == ["pmid", "title", "abstract", "extra", "tokens"]
    want = preprocess(df, ["title", "abstract"], 2, ["oral"], ["levels"]).orderBy("pmid").collect()
    assert [r["tokens"] for r in out.orderBy("pmid").collect()] == [r["tokens"] for r in want]
    assert want[0]["tokens"] == ["doseT", "drugnam", "rose", "drugnam rose"]


def test_vector_features(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for pmid in range(3):
        for part in ("abstract", "title"):
            kept = []
            for sentence in range(2):
                layers = rng.normal(size=(5, 6, 4))
                kept.append(layers[1:-1, -4:].sum(1))
                rows.append((pmid, part, sentence, layers.tolist()))
            all_tokens = np.vstack(kept)
            want[(pmid, part)] = np.concatenate([all_tokens.mean(0), all_tokens.max(0), all_tokens.min(0)])
    df = spark.createDataFrame(rows, "pmid bigint, part string, sentence int, layers array<array<array<double>>>")
    whole = J.vector_features(df, maxmin=True)
    for r in whole.collect():
        assert np.allclose(r["abstracts_embedded"], want[(r["pmid"], "abstract")])
        assert np.allclose(r["titles_embedded"], want[(r["pmid"], "title")])
    base = scratch_path(spark, "vectors")
    writers.write_parquet(df, f"{base}/tokens")
    assert J.vector_job(spark, f"{base}/tokens", f"{base}/out", 4) == ["biobert_all", "biobert_avg"]
    assert J.vector_job(spark, f"{base}/tokens", f"{base}/out", 4) == []
    stored_mean = spark.read.parquet(f"{base}/out/run=biobert_avg").where("pmid = 2").first()
    assert np.allclose(stored_mean["titles_embedded"], want[(2, "title")][:4])
    mean = J.joined_vectors(J.mean_only(whole, 4)).where("pmid = 1").first()["embedding"]
    assert np.allclose(mean, np.concatenate([want[(1, "abstract")][:4], want[(1, "title")][:4]]))


def test_runs_are_due_again_when_settings_or_content_change(spark, monkeypatch):
    base = scratch_path(spark, "manifests")
    rows = [(i, f"Study {i}", "Nothing of note.", "A", "Review") for i in range(12)]
    schema = "pmid bigint, title string, abstract string, mesh_terms string, publication_types string"
    writers.write_parquet(spark.createDataFrame(rows, schema), f"{base}/one")
    # The same rows in another order and other files are the same content.
    writers.write_parquet(spark.createDataFrame(rows[::-1], schema).repartition(3), f"{base}/two")

    def due(subset, runs=RUNS, **options):
        return J.feature_job(spark, f"{base}/{subset}", f"{base}/bow", runs, **options)

    assert due("one") == ["title", "optimal"] and due("one") == [] and due("two") == []
    assert due("one", stop_words=["study"]) == ["title", "optimal"] and due("one", stop_words=["study"]) == []
    assert due("one") == ["title", "optimal"]
    assert due("one", {**RUNS, "optimal": (RUNS["optimal"][0], 1)}) == ["optimal"]
    # Only the runs that read a changed field are due.
    changed = [(*r[:3], "B", r[4]) if r[0] == 5 else r for r in rows]
    writers.write_parquet(spark.createDataFrame(changed, schema), f"{base}/three")
    assert due("one") == ["optimal"] and due("three") == ["optimal"] and due("three") == []
    words = spark.createDataFrame([("note",)], "token string")
    assert due("three", lexicon=words) == ["title", "optimal"] and due("three", lexicon=words) == []
    assert due("three", lexicon=words.union(words.select(F.lit("study")))) == ["title", "optimal"]

    # A run that breaks off is due again, though some of its output is there.
    def broken(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(J.manifest, "commit", broken)
        due("one")
    assert spark.read.parquet(f"{base}/bow").where("run = 'title'").count() == 12
    assert due("one") == ["title", "optimal"] and due("one") == []


def test_evaluation_is_due_again_when_labels_change(spark):
    base = scratch_path(spark, "manifests")
    docs = spark.createDataFrame([(i, ["dose"] if i % 3 == 0 else ["none"]) for i in range(60)], "pmid bigint, tokens array<string>")
    labels = docs.select("pmid", F.when(F.col("pmid") % 3 == 0, POSITIVE).otherwise(NEGATIVE).alias("label"))

    def due(labels, params=PARAMS):
        return list(J.evaluation_job({"all": docs}, labels, f"{base}/results", f"{base}/tallies", 1, 0.2, replace(params, trees=1)))

    assert due(labels) == ["all"] and due(labels.repartition(3)) == []
    other = labels.withColumn("label", F.when(F.col("pmid") == 3, NEGATIVE).otherwise(F.col("label")))
    assert due(other) == ["all"] and due(other) == [] and due(other, replace(PARAMS, max_depth=3)) == ["all"]


def test_key_fingerprints(spark):
    from docsieve.operators import checks

    one = spark.createDataFrame([(i, str(i % 3)) for i in range(50)] + [(None, None)], "pmid bigint, x string")
    two = one.orderBy(F.desc("pmid")).repartition(4)
    assert checks.multiset_fingerprint(one) == checks.multiset_fingerprint(two)
    plan = checks.same_multiset(one, two, "pmid")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # no key is moved
    for other in (two.where("pmid > 0"), two.union(one.limit(1)), two.withColumn("pmid", F.col("pmid") + F.when(F.col("pmid") == 7, 100).otherwise(0))):
        assert not checks.same_multiset(one, other, "pmid").first()["same"]
        with pytest.raises(ValueError, match="differ"):
            checks.require_same_keys(one, other)
    checks.require_same_keys(one, two)
    twice = one.union(one)
    with pytest.raises(ValueError, match="repeated_left"):
        checks.require_same_keys(twice, twice)
    assert checks.same_multiset(one.limit(0), two.limit(0), "pmid").first()["same"]
