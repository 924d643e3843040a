"""Scoring documents whose text and vector arrive apart, in either order.

Both streams are brought together by key in a stateful step: what has come of a document
waits in the state until the rest is there, however late, and a document that arrives again
is scored again with its newest parts.  Scores are written batch by batch under the batch's
own name, so a batch that runs twice leaves the same rows; :func:`compact` folds finished
batches into one row per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rows import latest_by_key
from ..plans.model import score
from .scoring import ARRIVAL

_PARTS = "tokens array<string>, embedding array<double>, arrived timestamp, arrived_file string"
_SCORED = ("pmid", "prediction", "probability", *ARRIVAL)


def arriving(spark: SparkSession, source: str, schema, max_files: int | None = None) -> DataFrame:
    """New Parquet files below ``source`` with the time and name they arrived under."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.parquet(source).select(
        "*", F.col("_metadata.file_modification_time").alias(ARRIVAL[0]), F.col("_metadata.file_name").alias(ARRIVAL[1])
    )


def _complete(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Newest tokens and vector of one document; a row as soon as both are there."""
    parts = {"tokens": (None, None), "embedding": (None, None)}  # value and arrival of each
    if state.exists:
        tokens, tokens_at, vector, vector_at = state.get
        parts = {"tokens": (tokens, tokens_at), "embedding": (vector, vector_at)}
    for batch in batches:
        for row in batch.itertuples():
            at = (row.arrived.isoformat(), row.arrived_file)
            for name in parts:
                value, known = getattr(row, name), parts[name][1]
                if value is not None and (known is None or tuple(known) <= at):
                    parts[name] = (np.asarray(value).tolist(), list(at))
    (tokens, tokens_at), (vector, vector_at) = parts["tokens"], parts["embedding"]
    state.update((tokens, tokens_at, vector, vector_at))
    if tokens is not None and vector is not None:
        at, file = max(tuple(tokens_at), tuple(vector_at))
        yield pd.DataFrame({
            "pmid": [key[0]], "tokens": [tokens], "embedding": [vector], "arrived": [pd.Timestamp(at)], "arrived_file": [file],
        })


def completed(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(pmid, tokens, embedding, arrived, arrived_file): each document whenever its newest tokens
    and its newest vector are both there.

    ``documents`` (pmid, tokens) and ``vectors`` (pmid, embedding) are streams with arrival
    columns.  Rows with a NULL key or a NULL part say nothing and are left out.  The state
    holds the newest parts of every document that has come; nothing in it expires.
    """
    nothing = {"tokens": F.lit(None).cast("array<string>"), "embedding": F.lit(None).cast("array<double>")}
    one = documents.select("pmid", "tokens", nothing["embedding"].alias("embedding"), *ARRIVAL).where("tokens IS NOT NULL")
    two = vectors.select("pmid", nothing["tokens"].alias("tokens"), F.col("embedding").cast("array<double>"), *ARRIVAL)
    both = one.unionByName(two.where("embedding IS NOT NULL")).where("pmid IS NOT NULL")
    return both.groupBy("pmid").applyInPandasWithState(
        _complete, f"pmid bigint, {_PARTS}",
        "tokens array<string>, tokens_at array<string>, embedding array<double>, embedding_at array<string>",
        "append", GroupStateTimeout.NoTimeout,
    )


def write_batch(scored: DataFrame, sink: str, batch: int) -> None:
    """Rows of one batch below its own name; writing it again replaces it."""
    scored.select(*_SCORED).write.mode("overwrite").parquet(f"{sink}/batch={batch}")


def score_completed(
    model: PipelineModel, documents: DataFrame, vectors: DataFrame, sink: str, checkpoint: str
) -> StreamingQuery:
    """Score every completed document into ``sink``; runs until what is there is done."""

    def each(batch: DataFrame, number: int) -> None:
        write_batch(score(model, batch, keep=("pmid", *ARRIVAL)), sink, number)

    return (
        completed(documents, vectors)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _folders(spark: SparkSession, sink: str) -> tuple[int, dict[int, str], dict[int, str]]:
    """(last batch folded in, folded tables, batches after it); only finished folders count."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(sink)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"batch": {}, "upto": {}}
    if store.exists(root):
        for entry in store.listStatus(root):
            kind, _, number = entry.getPath().getName().partition("=")
            if kind in found and store.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                found[kind][int(number)] = entry.getPath().toString()
    last = max(found["upto"], default=-1)
    return last, found["upto"], {n: p for n, p in found["batch"].items() if n > last}


def newest_scores(spark: SparkSession, sink: str) -> DataFrame:
    """(pmid, prediction, probability, arrived, arrived_file): the newest score of every document."""
    last, folded, batches = _folders(spark, sink)
    paths = [(last, folded[last])] if folded else []
    rows = None
    for number, path in [*paths, *sorted(batches.items())]:
        part = spark.read.parquet(path).withColumn("_order", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], "pmid bigint, prediction string, probability double, arrived timestamp, arrived_file string")
    return latest_by_key(rows.withColumn("_arrival", F.struct(*ARRIVAL, "_order")), "_arrival").select(*_SCORED)


def compact(spark: SparkSession, sink: str) -> int:
    """Fold all finished batches into one table; returns the last batch in it, -1 if there is none.

    The folded table counts once it is whole; then what it replaces is deleted.  A run that
    breaks off in between leaves both, and readers use the folded one.
    """
    last, folded, batches = _folders(spark, sink)
    upto = max(batches, default=last)
    if batches:
        newest_scores(spark, sink).write.mode("overwrite").parquet(f"{sink}/upto={upto}")
    jvm = spark.sparkContext._jvm
    for path in [p for n, p in folded.items() if n < upto] + list(batches.values()):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return upto
