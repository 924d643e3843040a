"""Documents and vectors that arrive apart."""

import glob
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docsieve.catalog import model_queries as Q
from docsieve.plans import model as M
from docsieve.session import materialise, scratch_path
from docsieve.streaming import completion as C

DOCS = "pmid bigint, tokens array<string>"
VECTORS = "pmid bigint, embedding array<double>"


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(i, [f"w{i % 5}"] + (["dose"] if i % 4 == 0 else []), [float(i % 4 == 0), float(i % 3)]) for i in range(80)]
    df = materialise(spark.createDataFrame(rows, "pmid bigint, tokens array<string>, embedding array<double>"))
    labels = df.select("pmid", F.when(F.col("pmid") % 4 == 0, M.POSITIVE).otherwise(M.NEGATIVE).alias("label"))
    model = M.fit_final(df, labels, M.TreeParams(max_depth=2, trees=2, use_embedding=True))
    return df, model


def scores(df):
    return {r["pmid"]: round(r["probability"], 9) for r in df.collect()}


def test_either_order_and_upserts(spark, parts, monkeypatch):
    df, model = parts
    texts, vectors, sink, checkpoint = (scratch_path(spark, n) for n in ("texts", "vectors", "sink", "stream"))
    spark.createDataFrame([], DOCS).write.parquet(texts)
    spark.createDataFrame([], VECTORS).write.parquet(vectors)

    def arrive(rows, path):
        rows.coalesce(1).write.mode("append").parquet(path)

    def run():
        C.score_completed(model, C.arriving(spark, texts, DOCS), C.arriving(spark, vectors, VECTORS), sink, checkpoint).awaitTermination()
        return scores(C.newest_scores(spark, sink))

    assert scores(C.newest_scores(spark, sink)) == {}
    batch = scores(M.score(model, df))
    early, late = df.where("pmid < 40"), df.where("pmid >= 40")
    arrive(early.select("pmid", "tokens"), texts)  # text first
    arrive(late.select("pmid", "embedding"), vectors)  # vector first
    assert run() == {}
    arrive(early.where("pmid < 20").select("pmid", "embedding"), vectors)
    arrive(late.select("pmid", "tokens"), texts)
    arrive(spark.createDataFrame([(None, ["x"]), (999, ["x"])], DOCS), texts)  # no key; a vector that never comes
    assert run() == {k: v for k, v in batch.items() if k < 20 or k >= 40}
    arrive(early.where("pmid >= 20").select("pmid", "embedding"), vectors)
    assert run() == batch and run() == batch  # the second run finds nothing new
    # A text comes again with other words, a vector with other numbers: the newest of both counts.
    changed = df.where("pmid in (4, 6)").withColumn("tokens", F.array(F.lit("w1")))
    arrive(changed.select("pmid", "tokens"), texts)
    moved = df.where("pmid = 6").withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    arrive(moved.select("pmid", "embedding"), vectors)
    want = {**batch, **scores(M.score(model, changed)), **scores(M.score(model, moved.withColumn("tokens", F.array(F.lit("w1")))))}
    assert run() == want
    # Folding changes nothing, twice neither; a batch that is written again is the same batch.
    last = C.compact(spark, sink)
    assert scores(C.newest_scores(spark, sink)) == want and C.compact(spark, sink) == last
    assert C._folders(spark, sink)[2] == {}
    arrive(df.where("pmid = 8").select("pmid", "tokens"), texts)
    assert run() == want and C.newest_scores(spark, sink).count() == 80


def test_a_batch_written_twice_counts_once(spark, parts):
    df, model = parts
    sink = scratch_path(spark, "sink")
    arrived = df.withColumns({"arrived": F.timestamp_seconds(F.col("pmid")), "arrived_file": F.lit("f")})
    scored = M.score(model, arrived, keep=("pmid", "arrived", "arrived_file"))
    for _ in range(2):
        C.write_batch(scored.where("pmid < 50"), sink, 0)
    C.write_batch(scored.where("pmid >= 30").withColumn("probability", F.lit(2.0)), sink, 1)
    got = scores(C.newest_scores(spark, sink))
    assert len(got) == 80 and [v for k, v in sorted(got.items())][30:] == [2.0] * 50  # of equal arrivals the later batch
    assert C.compact(spark, sink) == 1 and scores(C.newest_scores(spark, sink)) == got
    # A folded table that broke off does not count.
    scored.limit(1).select(*C._SCORED).write.parquet(f"{sink}/upto=7")
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{sink}/upto=7/_SUCCESS")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(mark, False)
    assert scores(C.newest_scores(spark, sink)) == got


def test_texts_meet_their_vectors_before_they_are_cut(spark, tmp_path):
    """The same tokens and pairs as by a join of token lists, without moving the lists."""
    docs = [(1, "Some words\nand 3 more", "en", "a"), (2, "others", "en", "b"), (2, "others", "en", "b"), (3, None, None, "c"), (None, "no key", "en", "d")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = spark.createDataFrame([(2, [1.0]), (3, None), (7, [2.0]), (None, [3.0])], "pmid bigint, embedding array<double>")
    whole = Q.with_vectors(spark, str(tmp_path), vectors)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.rindex("ArrowEval") < plan.index("Join")  # from the top: the tokens, below them the join
    texts = Q.bags(spark, str(tmp_path))
    assert sorted(map(str, whole.select("pmid", "tokens").collect())) == sorted(map(str, texts.collect()))
    both = texts.join(vectors, "pmid").select("pmid", "tokens", "embedding")
    assert sorted(map(str, whole.where("there").select("pmid", "tokens", "embedding").collect())) == sorted(map(str, both.collect()))


def test_batches_do_not_grow_with_the_documents(spark, tmp_path, monkeypatch):
    """Some 8 batches an arrival, where 200 documents a file and three files a batch made one for every 600."""
    n, asked = 400 * max(3, spark.sparkContext.defaultParallelism) * Q.BATCHES, []
    docs = spark.range(n, numPartitions=1).select(F.col("id").alias("pmid"), F.lit("t").alias("title"))
    paths = iter([f"{tmp_path}/{name}" for name in ("arrivals", "scores", "stream")])
    monkeypatch.setattr(Q, "final_model", lambda *a: None)
    monkeypatch.setattr(Q, "new_documents", lambda *a: docs)
    monkeypatch.setattr(Q, "scratch_path", lambda *a: next(paths))
    stream = lambda *a, max_files: asked.append((len(glob.glob(f"{a[2]}/*.parquet")), max_files)) or SimpleNamespace(awaitTermination=lambda: None)
    monkeypatch.setattr(Q, "score_stream", stream)
    monkeypatch.setattr(Q.M, "score", lambda *a: docs.select("pmid", F.lit(0.5).alias("probability")))
    monkeypatch.setattr(Q.P, "preprocess", lambda *a: docs)
    monkeypatch.setattr(Q, "latest_scores", lambda *a: docs.select("pmid", F.lit(0.5).alias("probability")))
    assert Q.incremental_score(spark, "").where("equals_batch").count() == n
    assert len(asked) == 2 and all(0 < files <= arrival * Q.BATCHES * most for arrival, (files, most) in enumerate(asked, start=1))
    assert spark.read.parquet(f"{tmp_path}/arrivals").count() == 2 * n
