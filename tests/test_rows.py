"""Joins, checks, lookups, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from docsieve.functions.naming import experiment_name
from docsieve.operators import checks, rows
from docsieve.operators.report import display_names, stack_results
from docsieve.sources import readers, writers


def test_id_parity_counts(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "pmid bigint")
    b = spark.createDataFrame([(2,), (3,), (4,), (4,)], "pmid bigint")
    assert tuple(checks.id_parity(a, b).first()) == (1, 1, 1, 1)
    with pytest.raises(ValueError, match="keys"):
        checks.require_same_keys(a, b)
    checks.require_same_keys(a.distinct(), a.distinct())


def test_strict_labels(spark):
    features = spark.createDataFrame([(1, "x"), (2, "y")], "pmid bigint, f string")
    two = spark.createDataFrame([(1, "a"), (2, "b")], "pmid bigint, label string")
    one = spark.createDataFrame([(1, "a"), (2, "a")], "pmid bigint, label string")
    assert rows.attach_labels(features, two).count() == 2
    with pytest.raises(ValueError, match="1 distinct"):
        rows.attach_labels(features, one)
    with pytest.raises(ValueError, match="only_left"):
        rows.attach_labels(features, two.where("pmid = 1"))


def test_mask_with_null_keys_and_null_words(spark):
    docs = spark.createDataFrame(
        [(1, ["Aspirin", "and", "aspirin"]), (2, ["none"]), (3, []), (3, ["Ibuprofen"]), (None, ["aspirin", "x"])],
        "pmid bigint, tokens array<string>",
    )
    lexicon = spark.createDataFrame([("aspirin",), ("IBUPROFEN",), (None,)], "token string")
    want = [(1, ["DRUGNAME", "and", "DRUGNAME"]), (2, ["none"]), (3, []), (3, ["DRUGNAME"]), (None, ["DRUGNAME", "x"])]
    out = rows.mask_tokens(docs, lexicon)
    assert out.columns == ["pmid", "tokens"]
    assert sorted((str(r["pmid"]), r["tokens"]) for r in out.collect()) == sorted((str(i), t) for i, t in want)
    assert rows.mask_tokens(docs, lexicon.limit(0)).count() == 5


def test_rename_keeps_unknown(spark):
    df = spark.createDataFrame([("res_mesh",), ("zzz",)], "experiment string")
    got = {r[0] for r in rows.rename_values(df, "experiment", display_names(df)).collect()}
    assert got == {"MeSH", "zzz"}


def test_latest_by_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "pmid bigint, t int, v string")
    assert {(r["pmid"], r["v"]) for r in rows.latest_by_key(df, "t").collect()} == {(1, "c"), (2, "z")}


def test_experiment_names(spark):
    df = spark.createDataFrame([("dev_optimal.parquet",), ("training_specter.jsonl",)], "f string")
    got = [tuple(r) for r in df.select(
        experiment_name("f"), experiment_name("f", use_idf=True), experiment_name("f", use_bow=True)
    ).collect()]
    assert got == [("optimal", "optimal_idf", "optimal_bow"), ("specter", "specter", "specter_bow")]


def test_pending_runs(spark):
    matrix = spark.createDataFrame([("title",), ("mesh",), ("test_unigrams",)], "run string")
    done = spark.createDataFrame([("mesh",)], "run string")
    assert [r[0] for r in writers.pending_runs(matrix, done).collect()] == ["title"]
    assert {r[0] for r in writers.pending_runs(matrix, done, overwrite=True).collect()} == {"title", "mesh"}


def test_jsonl_drops_broken_lines(spark, tmp_path):
    lines = ['{"paper_id": "7", "embedding": [1.5, 2.0]}', '{"paper_id": "8", "embed', '{"paper_id": "9", "embedding": [0.5]}']
    (tmp_path / "v.jsonl").write_text("\n".join(lines))
    got = readers.read_embeddings_jsonl(spark, str(tmp_path / "v.jsonl")).orderBy("pmid").collect()
    assert [(r["pmid"], r["embedding"]) for r in got] == [(7, [1.5, 2.0]), (9, [0.5])]


def test_multiline_csv_and_labels(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        'abstract,mesh_terms,publication_types,title,pmid\n"first\nsecond, ""quoted""",,Review,"A title",12\nplain,,,,\n'
    )
    got = rows.normalise(
        readers.read_documents_csv(spark, str(tmp_path / "d.csv")),
        {"pmid": 0, "abstract": "", "mesh_terms": "", "publication_types": "", "title": ""},
    ).orderBy("pmid").collect()
    assert [tuple(r) for r in got] == [
        ("plain", "", "", "", 0), ('first\nsecond, "quoted"', "", "Review", "A title", 12),
    ]
    (tmp_path / "l.csv").write_text("ID,pmid,Dataset,label\n1,20,test,Not Relevant\n2,30,test,Relevant\n")
    labels = readers.read_labels(spark, str(tmp_path / "l.csv")).orderBy("pmid").collect()
    assert [tuple(r) for r in labels] == [(20, "test", "Not Relevant"), (30, "test", "Relevant")]


def test_results_files_and_folders(spark, tmp_path):
    (tmp_path / "res_title.csv").write_text(",Precision,Recall,F1-score\n0,0.5,0.25,0.33\n1,0.6,0.2,0.3\n")
    metrics = spark.createDataFrame([(0, 0.1, 0.2, 0.3)], "round int, precision double, recall double, f1 double")
    writers.write_results(metrics, str(tmp_path), "res_mesh")
    got = readers.read_results(spark, f"{tmp_path}/res_*.csv").orderBy("experiment", "round").collect()
    assert [tuple(r) for r in got] == [
        ("res_mesh", 0, 0.1, 0.2, 0.3), ("res_title", 0, 0.5, 0.25, 0.33), ("res_title", 1, 0.6, 0.2, 0.3),
    ]
    assert stack_results(metrics, metrics).count() == 2


def test_metadata_export(spark, tmp_path):
    df = spark.createDataFrame(
        [(5, 1, "old", "x"), (5, 2, 'new "q"', None), (6, 1, "t", "a")],
        "pmid bigint, seq int, title string, abstract string",
    )
    writers.write_metadata(df, "seq", str(tmp_path), "training")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/training_meta.jsonl").collect()]
    merged = {}
    for line in lines:
        merged.update(json.loads(line))
    assert merged == {
        "5": {"title": 'new "q"', "abstract": None, "paper_id": "5"},
        "6": {"title": "t", "abstract": "a", "paper_id": "6"},
    }
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/training_ids.ids").collect()) == ["5", "5", "6"]


def test_dirty_keys(spark):
    df = spark.createDataFrame([("12",), ("x1",), (None,)], "k string")
    assert [r[0] for r in df.select(readers.cast_key("k")).collect()] == [12, None, None]
    assert rows.every_nth(spark.range(50).withColumnRenamed("id", "round"), "round").count() == 3
    assert rows.head(spark.range(50), [F.desc("id")], 2).collect()[0][0] == 49
