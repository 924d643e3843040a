"""Readers with explicit schemas; nothing is inferred by a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import RESULT_PATTERN
from .quoted_csv import read_quoted_csv

LABEL_SCHEMA = T.StructType(
    [
        T.StructField("ID", T.LongType()),
        T.StructField("pmid", T.LongType()),
        T.StructField("Dataset", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)
# Header order of the scoring files.
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("abstract", T.StringType()),
        T.StructField("mesh_terms", T.StringType()),
        T.StructField("publication_types", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("pmid", T.LongType()),
    ]
)
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("round", T.LongType()),
        T.StructField("Precision", T.DoubleType()),
        T.StructField("Recall", T.DoubleType()),
        T.StructField("F1-score", T.DoubleType()),
    ]
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Parquet corpus with an integer key; columns and filters reach the scan."""
    df = spark.read.parquet(path)
    return df.withColumn("pmid", cast_key("pmid")) if "pmid" in df.columns else df


def cast_key(col: str | Column) -> Column:
    """Key as bigint; a value that is no number becomes NULL."""
    return (F.col(col) if isinstance(col, str) else col).try_cast("bigint")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV to (pmid, dataset, label)."""
    raw = spark.read.schema(LABEL_SCHEMA).option("header", True).csv(path)
    return raw.select("pmid", F.col("Dataset").alias("dataset"), "label")


def read_documents_csv(
    spark: SparkSession, path: str, schema: T.StructType | str = DOCUMENT_SCHEMA
) -> DataFrame:
    """Quoted CSV with a header, whose fields may hold newlines and quotes; a large file is
    read by many tasks."""
    return read_quoted_csv(spark, path, schema)


def read_embeddings_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line to (pmid, embedding).

    A line counts if it is JSON and its embedding is a list of numbers, whichever
    columns are asked for: both fields are parsed in one step and the test reads
    the embedding, so column pruning cannot change the rows.  Whole numbers count,
    a key that is no number becomes NULL.
    """
    parsed = F.from_json("value", "paper_id string, embedding array<double>, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    lines = spark.read.text(path).select(parsed.alias("line"))
    whole = lines.where(F.col("line._broken").isNull() & F.col("line.embedding").isNotNull() & ~F.exists("line.embedding", lambda x: x.isNull()))
    return whole.select(cast_key("line.paper_id").alias("pmid"), F.col("line.embedding").alias("embedding"))


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """Metric files ``res_*.csv`` (single files or Spark folders of that name)
    with the name as experiment."""
    return (
        spark.read.schema(RESULT_SCHEMA)
        .option("header", True)
        .csv(glob)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), RESULT_PATTERN, 1).alias("experiment"),
            "round",
            F.col("Precision").alias("precision"),
            F.col("Recall").alias("recall"),
            F.col("`F1-score`").alias("f1"),
        )
    )
