"""Hard-negative mining by matrix products in a residue number system.

Components become whole numbers; a product of two matrices is taken modulo several
small primes in float32, where every partial sum is below 2^24 and so exact in any
order, and the signed scores come back by Chinese remaindering.  Two passes follow:
the first finds each anchor's positives, the second the negatives whose score lies in
the window each positive opens.

Rows are dealt into stripes and anchors into groups of bounded size; a cell is one
group against one stripe, one task's work, and sends on a few rows per anchor.  No pair
of rows leaves a cell that is not among its anchor's best.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .registry import query, table

#: Bytes of components in a stripe of rows, and in a group of anchors.
CELL_BYTES = 32 << 20
#: Rows of a cell scored at once, and anchors.
TILE, ANCHOR_TILE = 4096, 512
EXACT = 1 << 24  # whole numbers up to this are exact in float32
LARGEST = 1 << 54  # scores below this, a hundred times them and the primes' product fit a long


def primes_for(bound: int) -> list[int]:
    """Primes below 256, largest first, whose product exceeds twice the bound: three at least."""
    chosen, product = [], 1
    for p in (n for n in range(255, 2, -2) if all(n % k for k in range(3, 16, 2))):
        if product > 2 * bound + 1 and len(chosen) >= 3:
            return chosen
        chosen.append(p)
        product *= p
    raise ValueError("no primes left")


class Residues:
    """Exact signed inner products of whole-number matrices, for |products| up to ``bound``."""

    def __init__(self, bound: int):
        self.primes = primes_for(bound)
        # Inverse of the product of the primes before each, modulo it.
        self.inverse = [pow(math.prod(self.primes[:i]), -1, p) for i, p in enumerate(self.primes)]

    def split(self, matrix: np.ndarray) -> list[np.ndarray]:
        """A float32 matrix for each prime, of residues about zero."""
        out = []
        for p in self.primes:
            r = np.remainder(matrix, p).astype(np.float32)
            r[r > p // 2] -= p
            out.append(r)
        return out

    def product(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """int64 scores of every row of ``a`` with every row of ``b``."""
        total, scale, half = None, 1, math.prod(self.primes) // 2
        for i, p in enumerate(self.primes):
            step = EXACT // (p // 2) ** 2  # columns whose sum stays exact
            r = np.zeros((len(a[i]), len(b[i])), np.int64)
            for at in range(0, a[i].shape[1], step):
                r += (a[i][:, at : at + step] @ b[i][:, at : at + step].T).astype(np.int32)
            if total is None:
                total = r % p
            else:  # the next mixed-radix digit
                total += (r - total) % p * self.inverse[i] % p * scale
            scale *= p
        return np.where(total > half, total - scale, total)


class Best:
    """The ``k`` highest (score, id) of each of ``n`` lists, ties by smaller id, fed block by block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.row = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)  # the k-th best so far

    def add(self, at: int, scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """Lists ``at``, ``at`` + 1, ... get their row of ``scores`` where ``wanted``."""
        least = self.least[at : at + len(scores), None]
        wanted = wanted & (scores >= least)
        if np.count_nonzero(wanted) > 4 * self.k * len(scores) and scores.shape[1] > self.k:
            masked = np.where(wanted, scores, np.iinfo(np.int64).min)
            kth = np.partition(masked, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            wanted &= scores >= kth[:, None]
        row, col = np.nonzero(wanted)
        if not len(row):
            return
        old = (self.row >= at) & (self.row < at + len(scores))
        row, score, id_ = (
            np.concatenate([kept[old], new])
            for kept, new in ((self.row, row + at), (self.score, scores[row, col]), (self.id, ids[col]))
        )
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        keep = rank < self.k
        full = rank == self.k - 1
        self.least[row[full]] = score[full]
        self.row, self.score, self.id = (
            np.concatenate([kept[~old], new[keep]])
            for kept, new in ((self.row, row), (self.score, score), (self.id, id_))
        )


def _matrix(rows: pa.Table, column: str, width: int) -> np.ndarray:
    """The lists of a column as one matrix; shorter ones end in zeros."""
    lists = rows.column(column).combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _numbers(rows: pa.Table, column: str) -> np.ndarray:
    return rows.column(column).to_numpy()


def _cell(residues: Residues, width: int, k: int, windows: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The work of one cell: each anchor's best rows of its label or, with ``windows``, the
    best rows of other labels within every one of its windows."""

    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _partial()
        rows = rows.sort_by("id")
        ids, labels, uids = (_numbers(rows, c) for c in ("id", "label", "uid"))
        own, own_labels, own_uids = _matrix(anchors, "q", width), _numbers(anchors, "label"), _numbers(anchors, "uid")
        if windows:
            low, high = _matrix(anchors, "low", k_windows(anchors)), _matrix(anchors, "high", k_windows(anchors))
            spans = np.diff(anchors.column("low").combine_chunks().offsets.to_numpy())
            best = [Best(len(anchors), k) for _ in range(low.shape[1])]
        else:
            best = [Best(len(anchors), k)]
        whole = _matrix(rows, "q", width)
        for start in range(0, len(rows), TILE):
            part = slice(start, start + TILE)
            right = residues.split(whole[part])
            for at in range(0, len(anchors), ANCHOR_TILE):
                here = slice(at, at + ANCHOR_TILE)
                scores = residues.product(residues.split(own[here]), right)
                same = own_labels[here, None] == labels[None, part]
                if not windows:
                    best[0].add(at, scores, same & (own_uids[here, None] != uids[None, part]), ids[part])
                    continue
                for w, found in enumerate(best):
                    inside = ~same & (scores >= low[here, w, None]) & (scores <= high[here, w, None])
                    found.add(at, scores, inside & (spans[here, None] > w), ids[part])
        return pa.concat_tables(_partial(own_uids[b.row], w, b.id, b.score) for w, b in enumerate(best))

    return work


def k_windows(anchors: pa.Table) -> int:
    return int(np.diff(anchors.column("low").combine_chunks().offsets.to_numpy()).max())


def _partial(uid=(), place: int = 0, ids=(), scores=()) -> pa.Table:
    return pa.table({
        "uid": pa.array(uid, pa.int64()), "place": pa.array(np.full(len(uid), place), pa.int32()),
        "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64()),
    })


_PARTIAL = "uid long, place int, id long, score long"


def _search(anchors: DataFrame, rows: DataFrame, groups: int, stripes: int, work, k: int) -> DataFrame:
    """(uid, place, best): the ``k`` best of all cells, as (score with its sign changed, id)."""
    cells = groups * stripes
    left = anchors.withColumns({
        "g": F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"), "s": F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    }).repartition(cells, "g", "s")
    right = rows.withColumns({
        "s": F.pmod(F.xxhash64("uid"), F.lit(stripes)).cast("int"), "g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    }).repartition(cells, "g", "s")
    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(work, _PARTIAL)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")))
    return found.groupBy("uid", "place").agg(F.slice(ordered, 1, k).alias("best"))


def mine(
    rows: DataFrame,
    anchor: Column,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row where ``anchor`` holds is an anchor.  Its positives are its best other rows of
    its label; for each, the best rows of other labels whose score is ``low`` to ``high``
    per cent of the positive's are returned.  Ids and labels are whole numbers.

    Rows with a null id, label or vector, or a null or infinite component or NaN, take no
    part.  Shorter vectors count as ending in zeros, so an empty one scores 0 with all.
    Repeated rows count one by one: a copy of an anchor is another row, and an anchor that
    is there twice is answered twice.  Ties go to the smaller id.  An empty table has no
    anchors and gives no rows.  Other columns are not read.  A squared length
    of 2^54 or more, after scaling, is refused with an error.
    """
    x = rows[vector]
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    part = rows.where(rows[id].isNotNull() & rows[label].isNotNull() & x.isNotNull() & finite).select(
        rows[id].cast("long").alias("id"), rows[label].cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("x"),
    )
    squared = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    size = part.agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("x")).alias("width"),
        F.max(squared).alias("squared"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"),
    ).first()
    bound = math.ceil((size["squared"] or 0.0) * (1 + 1e-9)) + 1
    if bound >= LARGEST:
        raise ValueError(f"scores of up to {bound} are too large; use a smaller scale")
    kind, width = ("smallint", 2) if (size["most"] or 0) < 1 << 15 else ("int", 4) if size["most"] < 1 << 31 else ("bigint", 8)
    width *= max(size["width"] or 1, 1)
    whole = materialise(
        part.select("id", "label", "anchor", F.col("x").cast(f"array<{kind}>").alias("q"), F.monotonically_increasing_id().alias("uid")),
        "rows",
    )
    per_core = min(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size["n"] / TILE))
    stripes = max(1, per_core, math.ceil(size["n"] * width / cell_bytes))
    groups = max(1, math.ceil(size["anchors"] * width / cell_bytes))
    residues, columns = Residues(bound), max(size["width"] or 0, 0)
    asked = whole.where("anchor").select("uid", F.col("id").alias("anchor_id"), "label", "q")
    everything = whole.select("uid", "id", "label", "q")
    first = _search(asked, everything, groups, stripes, _cell(residues, columns, positives, False), positives)
    near = first.select("uid", F.transform("best", lambda b: F.struct(b["id"].alias("id"), (-b["minus"]).alias("score"))).alias("found"))

    def floor_share(score: Column, per_cent: int) -> Column:
        hundredfold = score * per_cent
        return F.call_function("div", hundredfold - F.pmod(hundredfold, F.lit(100).cast("long")), F.lit(100).cast("long"))

    def limit(per_cent: int, up: bool) -> Column:
        sign = -1 if up else 1
        return F.transform("found", lambda b: sign * floor_share(sign * b["score"], per_cent))

    windows = materialise(
        near.join(asked, "uid").select("uid", "anchor_id", "label", "q", "found", limit(low, True).alias("low"), limit(high, False).alias("high")),
        "windows",
    )
    second = _search(
        windows.drop("found"), everything, groups, stripes, _cell(residues, columns, negatives, True), negatives
    )
    answers = second.select("uid", "place", F.posexplode("best").alias("rank", "negative"))
    return answers.join(windows.select("uid", "anchor_id", "found"), "uid").select(
        "anchor_id", F.get("found", F.col("place"))["id"].alias("positive_id"), (F.col("rank") + 1).alias("rank"),
        F.col("negative.id").alias("negative_id"), F.get("found", F.col("place"))["score"].alias("positive_score"),
        (-F.col("negative.minus")).alias("negative_score"),
    )


SQL = """
WITH part AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM part),
pairs AS MATERIALIZED (SELECT a.uid AS au, a.vec_id AS anchor_id, a.label = b.label AS same, b.uid, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM rows a, rows b WHERE a.vec_id % 50 = 0),
near AS (SELECT au, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY au ORDER BY score DESC, vec_id) AS place
  FROM pairs WHERE same AND au <> uid QUALIFY place <= 5)
SELECT near.anchor_id, positive_id, row_number() OVER (PARTITION BY near.au, place ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN pairs ON near.au = pairs.au AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every fiftieth id; the labels of every seventh are made wrong first."""
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", noisy), F.col("vec_id") % 50 == 0)
