"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.naming import RESULT_PREFIX
from ..operators.metrics import binary_metrics
from ..plans.preprocess import FIELD_RUNS
from ..session import scratch_path
from ..sources import readers, writers
from . import views as V
from .registry import query

ROUNDS = 3
CORPUS_SQL = f"WITH {V.SQL_CORPUS} SELECT pmid, title, abstract, journal, publication_types FROM corpus"


@query("s1_scan_corpus", CORPUS_SQL)
def scan_corpus(spark, sf_dir):
    return V.corpus(spark, sf_dir)


@query(
    "s2_labels_roundtrip",
    f"WITH {V.SQL_LABELS} SELECT pmid, 'given' AS dataset, label FROM labels_v",
)
def labels_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "labels")
    rows = V.labels(spark, sf_dir).select(
        F.col("pmid").alias("ID"), "pmid", F.lit("given").alias("Dataset"), "label"
    )
    writers.write_csv(rows, path)
    return readers.read_labels(spark, path)


@query(
    "s3_multiline_csv",
    f"WITH {V.SQL_CORPUS} SELECT pmid, title, abstract, publication_types FROM corpus",
)
def multiline_csv(spark, sf_dir):
    path = scratch_path(spark, "documents-csv")
    rows = V.corpus(spark, sf_dir).select(
        "abstract", F.lit("").alias("mesh_terms"), "publication_types", "title", "pmid"
    )
    writers.write_csv(rows, path)
    return readers.read_documents_csv(spark, path).na.fill("").drop("mesh_terms")


@query(
    "s4_jsonl_drop_bad",
    """SELECT vec_id AS pmid, len(embedding)::INTEGER AS width,
              round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total
       FROM embeddings WHERE vec_id % 7 <> 3""",
)
def jsonl_drop_bad(spark, sf_dir):
    """Every seventh line is cut in half before it is written."""
    path = scratch_path(spark, "vectors-jsonl")
    line = F.to_json(F.struct(F.col("vec_id").cast("string").alias("paper_id"), "embedding"))
    broken = F.expr("substring(line, 1, length(line) div 2)")
    (
        V.table(spark, sf_dir, "embeddings")
        .select("vec_id", line.alias("line"))
        .select(F.when(F.col("vec_id") % 7 == 3, broken).otherwise(F.col("line")).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return readers.read_embeddings_jsonl(spark, path).select(
        "pmid", F.size("embedding").alias("width"), F.round(total, 4).alias("total")
    )


@query("s5_parquet_roundtrip", CORPUS_SQL)
def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    writers.write_parquet(V.corpus(spark, sf_dir), path)
    return readers.read_corpus(spark, path)


@query(
    "s6_csv_roundtrip",
    f"""WITH {V.sql_metrics(ROUNDS)}
        SELECT experiment, round::BIGINT AS round, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1 FROM metrics""",
)
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "metrics-csv")
    metrics = binary_metrics(V.predictions(spark, sf_dir, ROUNDS), ["experiment", "round"])
    writers.write_csv(metrics.select("experiment", "round", "precision", "recall", "f1"), path)
    back = spark.read.schema("experiment string, round bigint, precision double, recall double, f1 double").option(
        "header", True
    ).csv(path)
    return back.select("experiment", "round", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "s7_export_json",
    """WITH ranked AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
                       FROM conversations)
       SELECT conv_id AS pmid, role AS title, md5(text) AS abstract_md5, conv_id::VARCHAR AS paper_id
       FROM ranked WHERE rn = 1""",
)
def export_json(spark, sf_dir):
    """Turns of a conversation play copies of one record; the last turn wins."""
    records = V.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("pmid"), "turn", F.col("role").alias("title"), F.col("text").alias("abstract")
    )
    parsed = F.from_json("json", "title string, abstract string, paper_id string")
    return (
        writers.export_metadata(records, "turn")
        .select("pmid", parsed.alias("r"))
        .select("pmid", "r.title", F.md5("r.abstract").alias("abstract_md5"), "r.paper_id")
    )


@query(
    "s8_pending_runs",
    f"""WITH {V.sql_metrics(ROUNDS)},
        matrix AS (SELECT unnest([{V.in_list([*FIELD_RUNS, "test_unigrams"])}]) AS run),
        done AS (SELECT DISTINCT replace(experiment, 'res_', '') AS run FROM metrics WHERE f1 > 0)
        SELECT run FROM matrix WHERE run NOT LIKE '%test%' AND run NOT IN (SELECT run FROM done)""",
)
def pending(spark, sf_dir):
    """Rules with a score above zero play the finished runs."""
    metrics = binary_metrics(V.predictions(spark, sf_dir, ROUNDS), ["experiment", "round"])
    done = metrics.where(F.col("f1") > 0).select(
        F.replace("experiment", F.lit(RESULT_PREFIX), F.lit("")).alias("run")
    ).distinct()
    matrix = spark.createDataFrame([(r,) for r in [*FIELD_RUNS, "test_unigrams"]], "run string")
    return writers.pending_runs(matrix, done)


@query(
    "s10_results_dir",
    f"""WITH {V.sql_metrics(ROUNDS)}
        SELECT experiment, round::BIGINT AS round, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1
        FROM metrics WHERE experiment IN ('res_title', 'res_optimal')""",
)
def results_dir(spark, sf_dir):
    path = scratch_path(spark, "results")
    metrics = binary_metrics(V.predictions(spark, sf_dir, ROUNDS), ["experiment", "round"])
    for name in ("res_title", "res_optimal"):
        writers.write_results(metrics.where(F.col("experiment") == name), path, name)
    return readers.read_results(spark, f"{path}/res_*.csv").select(
        "experiment", "round", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )
