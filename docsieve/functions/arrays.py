"""Vector columns stored as arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_ROWS = 512  # rows whose lists a worker takes apart at once


def slice_vector(vec: Column | str, n: int, start: int = 1) -> Column:
    """``n`` elements from position ``start`` (1-based)."""
    return F.slice(vec, start, n)


def concat_vectors(abstract_vec: Column | str, title_vec: Column | str) -> Column:
    """Abstract part first, then title part."""
    return F.concat(abstract_vec, title_vec)


def sum_last_layers(layers: Column | str, n: int = 4) -> Column:
    """Element-wise sum of the last ``n`` layers of one token, inside the row.

    ``layers`` is array<array<number>>; fewer than ``n`` layers are summed whole.
    """
    c = F.col(layers) if isinstance(layers, str) else layers
    last = F.slice(c, F.greatest(F.size(c) - (n - 1), F.lit(1)), n)
    width = F.size(F.element_at(c, 1))
    zero = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    return F.aggregate(last, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))


def sliced(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of a batch, ``SLICE_ROWS`` rows at a time: what a step makes of whole lists stays small."""
    for start in range(0, len(columns[0]), SLICE_ROWS):
        yield tuple(c.slice(start, SLICE_ROWS) for c in columns)


def vector_entries(vector: str | Column) -> Column:
    """The stored (place, value) entries of an ML vector column, as an array: those of a
    sparse vector, or every one of a dense."""
    v = F.unwrap_udt(F.col(vector) if isinstance(vector, str) else vector)
    places = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return F.zip_with(places, v["values"], lambda p, x: F.struct(p.alias("place"), x.alias("value")))
