"""Writers, metadata export and the book-keeping of finished runs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; embedded quotes are doubled so newlines survive."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("lineSep", "\n")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_results(metrics: DataFrame, directory: str, experiment: str) -> None:
    """One experiment's round metrics under its file name."""
    out = metrics.select(
        F.col("round"),
        F.col("precision").alias("Precision"),
        F.col("recall").alias("Recall"),
        F.col("f1").alias("F1-score"),
    )
    write_csv(out, f"{directory}/{experiment}.csv")


def export_metadata(df: DataFrame, order_col: str, key: str = "pmid") -> DataFrame:
    """(pmid, json) per key, the last record in ``order_col`` winning.

    ``max_by`` keeps one candidate per key on the map side, so many copies of a
    key never meet in one task.
    """
    record = F.struct("title", "abstract", F.col(key).cast("string").alias("paper_id"))
    return (
        df.groupBy(key)
        .agg(F.max_by(record, F.col(order_col)).alias("record"))
        .select(key, F.to_json("record", {"ignoreNullFields": "false"}).alias("json"))
    )


def export_ids(df: DataFrame, key: str = "pmid") -> DataFrame:
    """The id list: every row, copies included."""
    return df.select(F.col(key).cast("string").alias("value"))


def write_metadata(df: DataFrame, order_col: str, directory: str, name: str) -> None:
    """``{pmid: {...}}`` as one JSON object per line, and the id list as text."""
    lines = export_metadata(df, order_col).select(
        F.format_string('{"%s":%s}', F.col("pmid").cast("string"), F.col("json")).alias("value")
    )
    lines.write.mode("overwrite").text(f"{directory}/{name}_meta.jsonl")
    export_ids(df).write.mode("overwrite").text(f"{directory}/{name}_ids.ids")


def pending_runs(matrix: DataFrame, done: DataFrame, overwrite: bool = False, by: str = "run") -> DataFrame:
    """Runs still to do: those without finished output, test inputs left out."""
    runs = matrix.where(~F.contains(F.col(by), F.lit("test")))
    return runs if overwrite else runs.join(done.select(by), by, "left_anti")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)
