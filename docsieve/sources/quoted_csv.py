"""Quoted CSV with line ends inside fields, read in pieces of a file.

Whether a line end closes a record hangs on all quotes before it, which is why such files
are usually one task.  Here every piece is a two-state automaton: an odd number of quotes
turns "inside" into "outside" and back, an even one leaves the state.  The pieces' parities
are composed over each file, and then every piece knows the state it starts in.

Records that lie within a piece are put together there.  Only the first lines of a piece
that still belong to a record before it, and the last record of a piece, are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

_PIECE = ("file", "block")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, odd): lines between line feeds, each with its piece of the
    file, its order there, and whether its quotes are odd in number."""
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", (quotes % 2).alias("odd"),
    )


def _states(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether each piece starts within quotes.  A row a piece."""
    parity = lines.groupBy(*_PIECE).agg((F.sum("odd") % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return parity.select(*_PIECE, (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("inside"))


def _numbered(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Lines with ``record``: how many records have begun in their piece; 0 for lines that
    go on with a record of an earlier piece."""
    upto = Window.partitionBy(*_PIECE).orderBy("at")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.col("inside") + F.coalesce(F.sum("odd").over(before), F.lit(0))) % 2
    begun = lines.join(states, [*_PIECE]).withColumn("begins", (inside == 0).cast("long"))
    return begun.withColumn("record", F.sum("begins").over(upto))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, record, text) of the records of all files of a path, header lines included.

    Quotes are those of RFC 4180: a field with a quote, comma or line end is quoted, a quote
    in it doubled.  A last record whose quotes never close runs to the end of its file.
    """
    lines = _lines(spark, path)
    states = materialise(_states(lines), "csv-pieces")
    numbered = _numbered(lines, states)
    ordered = F.sort_array(F.collect_list(F.struct("block_of", "at", "value")))
    text = F.array_join(F.transform(ordered, lambda line: line["value"]), "\n").alias("text")
    within = Window.partitionBy(*_PIECE)
    placed = materialise(numbered.withColumn("last", F.max("record").over(within)).drop("odd", "inside", "begins"), "csv-lines")
    # Whole records: each piece's own but the last.
    inner = placed.where((F.col("record") > 0) & (F.col("record") < F.col("last"))).withColumn("block_of", F.col("block"))
    whole = inner.groupBy(*_PIECE, "record").agg(text)
    # Lines at the edges go to the last record begun before them.
    pieces = placed.groupBy(*_PIECE).agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("last") > 0, F.struct("block", "last"))
    owners = pieces.select(*_PIECE, F.last(begun, ignorenulls=True).over(earlier).alias("owner"))
    edge = placed.where((F.col("record") == 0) | (F.col("record") == F.col("last"))).join(owners, [*_PIECE])
    moved = edge.select(
        "file", F.when(F.col("record") > 0, F.col("block")).otherwise(F.col("owner.block")).alias("block"),
        F.when(F.col("record") > 0, F.col("record")).otherwise(F.col("owner.last")).alias("record"),
        F.col("block").alias("block_of"), "at", "value",
    )
    return whole.unionByName(moved.groupBy(*_PIECE, "record").agg(text))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of quoted CSV files with a header each; one large file is many tasks.

    Empty records are skipped, as Spark's own reader does.
    """
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    found = records(spark, path).where(~((F.col("block") == 0) & (F.col("record") == 1)) & (F.col("text") != ""))
    options = {"quote": '"', "escape": '"', "lineSep": "\n", "multiLine": "true", "maxCharsPerColumn": "-1"}
    row = F.from_csv("text", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), options)
    return found.select(row.alias("row")).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])
