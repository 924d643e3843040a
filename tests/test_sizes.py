"""What a task holds stays small, however large the table."""

import pyarrow as pa
from pyspark.sql import functions as F

from docsieve.catalog import model_queries, row_queries
from docsieve.functions import arrays
from docsieve.functions.token_rules import replace_tokens
from docsieve.operators.phrases import mask_phrases


def test_lists_are_taken_apart_in_slices(spark):
    lists, spans = pa.array([["a"]] * 1300), pa.array(range(1300))
    parts = list(arrays.sliced(lists, spans))
    assert [len(p[0]) for p in parts] == [512, 512, 276] and parts[2][1][0].as_py() == 1024
    docs = spark.range(1300, numPartitions=1).select(
        "id", F.when(F.col("id") % 5 != 3, F.array(F.lit("the"), F.lit("x-1"), F.col("id").cast("string"))).alias("tokens")
    )
    masked = mask_phrases(docs, spark.createDataFrame([("THE X-1",), ("700",)], "phrase string"), mode="full")
    got = {r["id"]: (r["t"], r["tokens"]) for r in masked.join(docs.select("id", replace_tokens("tokens", ["the"]).alias("t")), "id").collect()}
    assert len(got) == 1300 and got[3] == (None, None) and got[700][1][-1] != "700"
    assert all(len(t) == 2 and m[-1] == str(i) for i, (t, m) in got.items() if i % 5 != 3 and i != 700)


def test_multisets_are_dealt_by_key(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = row_queries.multisets(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(source" not in plan  # one source: one task
    assert [(r["side"], r["same"]) for r in found.orderBy("side").collect()] == [("again", True), ("one changed", False), ("one less", False)]


def test_no_token_list_is_shuffled_for_its_vector(spark, tmp_path, monkeypatch):
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5), 64).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    plans, write = [], model_queries.materialise

    def seen(df, *names):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *names)

    monkeypatch.setattr(model_queries, "materialise", seen)
    assert model_queries.assemble(spark, str(tmp_path)).count() == 40
    assert plans[0].index("regexp_extract_all") < plans[0].index("Join")  # tokens are made above the join
