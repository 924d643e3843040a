"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from docsieve.catalog import views as V
from docsieve.operators import features, rows, splits
from docsieve.plans import preprocess as P
from docsieve.catalog import model_queries

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    """Tokens straight from a scan, as on a large corpus."""
    raw = V.table(spark, SF_DIR, "documents")
    return raw.select(F.col("doc_id").alias("pmid"), V.words("text").alias("tokens"))


@pytest.mark.parametrize(
    "name", ["top_relevant_terms", "a4_prf_by_round", "a12_doc_frequency", "j3_three_way", "m3_idf_l1", "w1_stratified_split", "a10_histogram", "a15_best_params"]
)
def test_no_cross_joins(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_text_is_tokenised_once(spark):
    for name in ("a12_doc_frequency", "a4_prf_by_round", "t6_stem_rollup", "a13_term_counts", "t14_sentences"):
        text = plan(contract.queries()[name](spark, SF_DIR))
        filters = [line for line in text.splitlines() if re.search(r"\bFilter |DataFilters", line)]
        assert not any("regexp_extract_all" in line for line in filters), name


def test_row_local_operators_do_not_shuffle(spark, docs):
    raw = V.as_corpus(V.table(spark, SF_DIR, "documents"))
    for df in (
        features.term_counts(docs),
        features.l1_frequency(docs),
        P.preprocess(raw, ["title", "abstract", "publication_types"], 3, ["the"], ["idiot"]),
        P.run_matrix(P.field_tokens(raw, ["title", "abstract"]), {"title": (("title",), 1), "abstract": (("title", "abstract"), 2)}),
        features.sentences_table(raw),
    ):
        text = plan(df)
        assert "Exchange" not in text and "Join" not in text


def test_document_frequency_is_one_combined_shuffle(docs):
    text = plan(features.document_frequency(docs, min_df=2))
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_stemming_is_one_python_step(spark):
    raw = V.as_corpus(V.table(spark, SF_DIR, "documents"))
    text = plan(P.preprocess(raw, ["title", "abstract"], 2))
    assert len(re.findall(r"ArrowEvalPython", text)) == 1


def test_subset_is_a_semi_join_before_text_work(spark):
    text = plan(V.labelled_tokens(spark, SF_DIR))
    assert "LeftSemi" in text
    above, below = text.split("LeftSemi", 1)
    assert "regexp_extract_all" in above and "regexp_extract_all" not in below


def test_scans_read_only_what_is_used(spark):
    text = plan(contract.queries()["p2_project"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in text
    text = plan(V.table(spark, SF_DIR, "labels").where("toxic = 1").select("doc_id"))
    assert "EqualTo(toxic,1)" in text


def test_rounds_do_not_multiply_the_shuffle(spark):
    """Assigned splits add a column: one broadcast of class rows, no exchange of the documents."""
    lab = V.labels(spark, SF_DIR)
    out = splits.assign_splits(lab, splits.holdout_cuts(lab, 200))
    top = plan(out).split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in top and "Exchange hashpartitioning" not in top


def test_runs_share_grams_and_what_is_made_of_tokens(spark):
    """Longer n-grams go on from shorter, lists too short for them as by a run of its own; made columns replace the bags."""
    rows = [(i, [f"w{k % 3}" for k in range(i)], [f"v{k}" for k in range(5 - i)]) for i in range(6)] + [(9, None, ["a"])]
    lists = spark.createDataFrame(rows, "pmid long, title array<string>, abstract array<string>")
    runs = {"one": (("title",), 1), "two": (("title", "abstract"), 2), "three": (("abstract", "title"), 3)}
    for keep_empty in (False, True):
        want = {(r["pmid"], n): r["tokens"] for n, (f, k) in runs.items() for r in P.combine_fields(lists, f, k, keep_empty).collect()}
        found = {(r["pmid"], r["run"]): r["tokens"] for r in P.run_matrix(lists, runs, keep_empty).collect()}
        made = {"n": F.size, "text": lambda t: F.array_join(t, "|")}
        short = P.run_matrix(lists, runs, keep_empty, made=made)
        assert found == want and short.columns == ["run", "pmid", "n", "text"]
        assert {(r["pmid"], r["run"]): r["text"] for r in short.collect()} == {k: None if t is None else "|".join(t) for k, t in want.items()}


def test_the_test_set_is_cut_into_tokens_with_the_training_set(spark, monkeypatch):
    folds, scores = [], spark.createDataFrame([(1, "x", True, "x")], "pmid int, correct_label string, result boolean, prediction string")
    monkeypatch.setattr(model_queries, "_fold", lambda *a: folds.append(1) or ("train", "labels", "test", "test labels"))
    monkeypatch.setattr(model_queries.M, "fit_final", lambda *a: "model")
    monkeypatch.setattr(model_queries.M, "evaluate", lambda *a: (scores, a))
    assert model_queries.test_eval(spark, "") == ("model", "test", "test labels") and folds == [1]
    assert model_queries.test_results(spark, "").columns == ["pmid", "correct_label", "consistent"] and folds == [1, 1]
