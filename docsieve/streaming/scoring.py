"""Scoring documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.rows import latest_by_key
from ..plans.model import score

ARRIVAL = ("arrived", "arrived_file")


def score_stream(
    model: PipelineModel,
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    sink: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    max_files: int | None = None,
    vectors: DataFrame | None = None,
) -> StreamingQuery:
    """Score every new Parquet file below ``source`` once, appending to ``sink``.

    ``prepare`` turns arriving columns into (pmid, tokens[, embedding]) and keeps
    the arrival columns.  Scoring is row-wise, so no state is held; the file
    source and sink with their checkpoint make each file count exactly once.  A
    stored table ``vectors`` (pmid, embedding) is joined to what arrives; where vectors
    arrive as well, :mod:`.completion` holds every document until its own has come.
    Runs until the files present are done.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arriving = reader.parquet(source).select(
        "*",
        F.col("_metadata.file_modification_time").alias(ARRIVAL[0]),
        F.col("_metadata.file_name").alias(ARRIVAL[1]),
    )
    ready = prepare(arriving) if prepare else arriving
    ready = ready if vectors is None else ready.join(vectors, "pmid")
    return (
        score(model, ready, keep=("pmid", *ARRIVAL))
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def latest_scores(spark: SparkSession, sink: str) -> DataFrame:
    """The newest score per document."""
    rows = spark.read.parquet(sink).withColumn("_arrival", F.struct(*ARRIVAL))
    return latest_by_key(rows, "_arrival").select("pmid", "prediction", "probability")
