"""Vector pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sum_last_layers
from .expand import records


def pool_vectors(df: DataFrame, by: str | Sequence[str], vec: str = "embedding", maxmin: bool = True) -> DataFrame:
    """(by, pooled): element-wise mean, or mean then max then min, per key.

    Whole vectors are folded into one buffer per key and task before the
    shuffle, so neither the width nor a key with most of the rows multiplies it.
    """
    keys = [by] if isinstance(by, str) else list(by)
    dense = df.select(*keys, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    wanted = ("mean", "max", "min") if maxmin else ("mean",)
    pooled = dense.groupBy(*keys).agg(Summarizer.metrics(*wanted).summary(F.col("_v")).alias("_s"))
    parts = [vector_to_array(F.col(f"_s.{m}")) for m in wanted]
    return pooled.select(*keys, F.concat(*parts).alias("pooled"))


def token_vectors(
    sentences: DataFrame, n: int = 4, keep: Sequence[str] = ("doc", "sentence"), layers: str = "layers"
) -> DataFrame:
    """(keep, tok, vec): the last ``n`` layers summed per token, the first and last
    token of every sentence dropped; ``tok`` counts from 0.

    One row is one sentence, ``layers`` its tokens x layers x width.  Slicing and
    summing stay in the row, so nothing is shuffled.
    """
    inner = F.slice(layers, 2, F.greatest(F.size(layers) - 2, F.lit(0)))
    vectors = F.transform(inner, lambda t: sum_last_layers(t, n))
    placed = F.transform(vectors, lambda v, i: F.struct((i + 1).alias("tok"), v.alias("vec")))
    return records(sentences, list(keep), placed, "tok")
