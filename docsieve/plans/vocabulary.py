"""Term vectors over a vocabulary of any size: ranked where it lies, joined instead of collected."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import term_runs
from ..operators.expand import records
from ..operators.features import idf
from ..session import materialise, scratch_path

_ROWS = (1 << 33) - 1  # the row number's bits of a monotonic id


def ranked(terms: DataFrame, use_idf: bool = False) -> DataFrame:
    """(token, place, factor) of (token, df[, n_docs]): most frequent first, ties by token.

    The terms are sorted over range partitions; a term's place is its place in its
    partition and the sizes of those before it.  One number a partition reaches the driver.
    """
    factor = idf() if use_idf else F.lit(1.0)
    order = [F.desc("df"), F.asc("token")]
    spread = terms.select("token", "df", factor.alias("factor")).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    written = materialise(
        spread.select("token", "factor", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit(_ROWS)).alias("at")), "ranked"
    )
    sizes = sorted((r["part"], r["n"]) for r in written.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    starts = terms.sparkSession.createDataFrame(offsets, "part long, start long")
    return written.join(starts, "part").select("token", (F.col("start") + F.col("at")).cast("int").alias("place"), "factor")


def sparse(size: int, entries: Column) -> Column:
    """What a sparse vector is made of: entries (place, value) ordered by place, scaled to an L1 norm of 1."""
    values = F.transform(entries, lambda e: e["value"])
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v))
    scaled = F.when(total > 0, F.transform(values, lambda v: v / total)).otherwise(values)
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform(entries, lambda e: e["place"]).alias("indices"), scaled.alias("values"),
    )


def term_vectors(docs: DataFrame, vocabulary: DataFrame, size: int, key: str, tokens: str, out: str) -> DataFrame:
    """(key, out): each row's L1 term weights over ``vocabulary`` (token, place, factor).

    ``key`` is different in every row.  Rows without a term of the vocabulary are left out.
    Tokens meet their place in a join, and a row's entries come together by its key.
    """
    counts = records(docs, [key], term_runs(tokens), "token")
    placed = counts.join(vocabulary, "token").select(
        key, F.struct("place", (F.col("n") * F.col("factor")).alias("value")).alias("entry")
    )
    folded = placed.groupBy(key).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    path = scratch_path(docs.sparkSession, "term-vectors")
    folded.select(key, sparse(size, F.col("entries")).alias(out)).write.parquet(path)
    # A stored vector is a struct; the schema makes it one again.
    schema = StructType([docs.schema[key], StructField(out, VectorUDT())])
    return docs.sparkSession.read.schema(schema).parquet(path)


class TermEncoder(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Term weights over a vocabulary kept as a table (token, place, factor), for any number of terms.

    Batches only: rows are joined with the table.  The table is stored with the model.
    """

    table = Param(Params._dummy(), "table", "path of the vocabulary table", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of terms", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, table: str = "", size: int = 0, inputCol: str = "tokens", outputCol: str = "term_weights") -> None:
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="term_weights")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        if df.isStreaming:
            raise ValueError("a vocabulary table takes batches; score a stream batch by batch")
        spark = df.sparkSession
        size, out = self.getOrDefault("size"), self.getOutputCol()
        rows = materialise(df.withColumn("_row_id", F.monotonically_increasing_id()), "to-encode")
        vocabulary = spark.read.parquet(self.getOrDefault("table"))
        vectors = term_vectors(rows, vocabulary, size, "_row_id", self.getInputCol(), "_weights")
        path = scratch_path(spark, "empty-vector")
        no_entries = F.array().cast("array<struct<place:int,value:double>>")
        spark.range(1).select(sparse(size, no_entries).alias("_none")).write.parquet(path)
        empty = spark.read.schema(StructType([StructField("_none", VectorUDT())])).parquet(path)
        # One row, for the rows without a term.
        joined = rows.join(vectors, "_row_id", "left").join(F.broadcast(empty), F.lit(True))
        return joined.select(*df.columns, F.coalesce("_weights", "_none").alias(out))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        SparkSession.active().read.parquet(self.instance.getOrDefault("table")).write.parquet(f"{path}/terms")


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> TermEncoder:
        stage = super().load(path)
        return stage._set(table=f"{path}/terms")


def table_encoder(terms: DataFrame, size: int, use_idf: bool, out: str = "term_weights") -> TermEncoder:
    """The encoder over ``size`` written terms (token, df[, n_docs])."""
    path = scratch_path(terms.sparkSession, "vocabulary")
    ranked(terms, use_idf).write.parquet(path)
    return TermEncoder(table=path, size=size, outputCol=out)
