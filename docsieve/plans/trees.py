"""Regression trees over sparse rows, grown level by level from histograms.

Spark's own learner holds every row as a dense array of binned features, so its memory and
time grow with rows times terms.  Here a row keeps the bins of its stored entries only, and
whatever is left of a node's sums lies in the bin of zero.  Candidate thresholds, gain and
leaves are those of Spark's learner: thresholds of a feature come from its sampled values,
the gain is the fall in variance, a leaf is the weighted mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import vector_entries
from ..operators.expand import records

MAX_BINS = 32  # of a feature
SAMPLE_ROWS = 10_000  # rows whose values become candidate thresholds, as in Spark's learner
EPSILON = 2.0**-52  # a gain up to this is none
ALIKE = 1e-9  # gains this near each other, relatively, are equal: the first feature and threshold win
DENSE_CELLS = 1 << 22  # sums of a level held as whole arrays up to so many, as lists beyond
BLOCK_CELLS = 1 << 16  # sums of a group of features whose best splits are sought together
BLOCKS_PER_CORE = 4  # groups at most
PASSES_PER_CORE = 2  # tasks a pass over the rows is dealt to, at most: each sends on sums of its own
LOCAL_ROWS = 1 << 14  # a leaf of up to so many rows is grown on by one task
LEVELS_APART = 3  # with more levels to come, such leaves leave the others' passes
LOCAL_ENTRIES = 1 << 22  # of so many rows with so many entries one task grows tree after tree
CHAIN_TREES = 256  # of one such task, at most
FEW_TREES = 2  # that are not worth such a task: their passes are shared by all cores
_SHARES = 1 << 20


@dataclass(frozen=True, eq=False)
class Layout:
    """Bins of all features, numbered on: those of feature 0, of feature 1, ..."""

    thresholds: np.ndarray  # feature after feature, ascending in each
    starts: np.ndarray  # place of each feature's first threshold, and their number at the end

    def __reduce__(self):
        return Layout, (self.thresholds, self.starts)  # the rest is worked out where it is needed

    @property
    def n_features(self) -> int:
        return len(self.starts) - 1

    @cached_property
    def first(self) -> np.ndarray:
        """First bin of each feature."""
        return self.starts[:-1] + np.arange(self.n_features)

    @property
    def n_bins(self) -> int:
        return len(self.thresholds) + self.n_features

    @cached_property
    def feature(self) -> np.ndarray:
        """Feature of each bin."""
        return np.repeat(np.arange(self.n_features), np.diff(self.starts) + 1)

    @cached_property
    def last(self) -> np.ndarray:
        """Last bin of each feature."""
        return self.first + np.diff(self.starts)

    @cached_property
    def zero(self) -> np.ndarray:
        """The bin of each feature that holds zero."""
        below = np.concatenate([[0], np.cumsum(self.thresholds < 0)])
        return self.first + below[self.starts[1:]] - below[self.starts[:-1]]

    def threshold(self, bin_: int, feature: int) -> float:
        """The upper end of a bin that is not its feature's last."""
        return float(self.thresholds[bin_ - feature])

    def bins(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Bin of every entry: its feature's first, and one on for each threshold below the value."""
        known = np.unique(self.thresholds)
        step = len(known) + 1
        edges = np.repeat(np.arange(self.n_features), np.diff(self.starts)) * step + np.searchsorted(known, self.thresholds)
        return np.searchsorted(edges, places * step + np.searchsorted(known, values)) + places


class Tree:
    """Nodes in the order they came; a feature of -1 marks a leaf."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right = [-1], [-1], [-1], [-1]
        self.gain = [0.0]
        self.sums: list[np.ndarray] = [np.zeros(4)]  # rows, weight, weighted sum and sum of squares

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        """Part a leaf after bin ``cut``; the new leaves."""
        left, right = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = left, right
        for values, new in ((self.feature, -1), (self.cut, -1), (self.left, -1), (self.right, -1), (self.gain, 0.0)):
            values += [new, new]
        self.sums += [np.zeros(4), np.zeros(4)]
        return left, right

    def walk(self) -> Walk:
        said = [s[2] / s[1] if s[1] else 0.0 for s in self.sums]
        return Walk(*map(np.array, (self.feature, self.cut, self.left, self.right, said)))


class Walk(NamedTuple):
    """What tasks need of a tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    said: np.ndarray

    def reached(self, flat: np.ndarray, row: np.ndarray, n: int, feature: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """The node in which each of ``n`` rows ends; ``flat`` are the bins of their entries, ``row`` whose."""
        node = np.zeros(n, dtype=np.int64)
        kept = asked_bins([self], feature, len(zero))[flat]
        flat, row = flat[kept], row[kept]
        of = feature[flat]
        while (self.feature[node] >= 0).any():
            node = self.step(node, flat, row, of, zero)
        return node

    def step(self, node: np.ndarray, flat: np.ndarray, row: np.ndarray, of: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """One level on from ``node``, leaves stay; ``of`` are the features of ``flat``."""
        asked = self.feature[node]
        goes_left = zero[asked] <= self.cut[node]  # without an entry: zero
        hit = of == asked[row]
        goes_left[row[hit]] = flat[hit] <= self.cut[node[row[hit]]]
        return np.where(asked >= 0, np.where(goes_left, self.left[node], self.right[node]), node)


def asked_bins(walks: Sequence[Walk], feature: np.ndarray, n_features: int) -> np.ndarray:
    """Whether each bin is of a feature that some of the trees split on."""
    used = np.zeros(n_features, dtype=bool)
    for walk in walks:
        used[walk.feature[walk.feature >= 0]] = True
    return used[feature] if n_features else np.zeros(0, dtype=bool)


# --- Thresholds and binned rows ---------------------------------------------

def candidate_thresholds(values: np.ndarray, weights: np.ndarray, sampled: float, most: int) -> np.ndarray:
    """Thresholds of one feature from its distinct non-zero values: between any two values, or
    at ``most`` steps of about equal weight.  What is missing to the ``sampled`` weight is zero."""
    missing = sampled - weights.sum()
    if missing > EPSILON * len(values) * 100:
        values, weights = np.append(values, 0.0), np.append(weights, missing)
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= most:
        return between
    stride = sampled / (most + 1)
    upto, target, kept = np.cumsum(weights).tolist(), stride, []
    for i, (one, two) in enumerate(zip(upto, upto[1:])):
        if abs(one - target) < abs(two - target):
            kept.append(i)
            if len(kept) == most:  # the next target is the whole weight, which no value passes
                break
            target += stride
    return between[kept]


def layout_of(rows: DataFrame, key: str, seed: int) -> Layout:
    """Candidate thresholds of every feature of ``rows`` (features, weight, ``key``).

    More than ``SAMPLE_ROWS`` rows are sampled for it by a hash of their key, so that the same
    rows give the same thresholds wherever they lie; ``key`` is the vector where there is none.
    """
    size = F.unwrap_udt(F.col("features"))
    width = F.coalesce(size["size"], F.size(size["values"]))
    whole = rows.agg(F.count("*").alias("n"), F.max(width).alias("width"), F.sum("weight").alias("w")).first()
    share = 1.0 if whole["n"] <= SAMPLE_ROWS else SAMPLE_ROWS / whole["n"]
    sample = rows if share == 1 else rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_SHARES)) < F.lit(int(share * _SHARES)))
    sampled = (whole["w"] if share == 1 else sample.agg(F.sum("weight")).first()[0]) or 0.0
    most = min(MAX_BINS, whole["n"]) - 1
    each = records(sample, ["weight"], vector_entries("features"), "value").where("value <> 0")
    counted = each.groupBy("place", "value").agg(F.sum("weight").alias("weight"))
    listed = counted.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("value", "weight"))).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            ends = found.offsets.to_numpy() - found.offsets[0].as_py()
            inner = found.flatten()
            values, weights = (inner.field(k).to_numpy(zero_copy_only=False) for k in ("value", "weight"))
            out = [candidate_thresholds(values[a:b], weights[a:b], sampled, most) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), pa.array(out, pa.list_(pa.float64()))], ["place", "thresholds"]
            )

    # At most MAX_BINS numbers a sampled feature.
    table = listed.mapInArrow(cut, "place int, thresholds array<double>").toArrow()
    table = table.combine_chunks().sort_by("place")
    lengths = np.zeros(whole["width"] or 0, dtype=np.int64)
    if not table.num_rows:
        return Layout(np.zeros(0), np.concatenate([[0], np.cumsum(lengths)]))
    lists = table.column("thresholds").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths[table.column("place").to_numpy()] = np.diff(lists.offsets.to_numpy())
    return Layout(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)]))


def binned(rows: DataFrame, layout: Layout) -> DataFrame:
    """(bins, target, weight, margin): the bins of a row's entries that are not their feature's zero."""
    shared = rows.sparkSession.sparkContext.broadcast(layout)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        zero = layout.zero
        for batch in batches:
            ends, places = _flat(batch.column("places"))
            values = batch.column("values").flatten().to_numpy().astype(np.float64)
            places = places.astype(np.int64)
            bins = layout.bins(places, values)
            kept = bins != zero[places]
            upto = np.concatenate([[0], np.cumsum(kept)])[ends]
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(bins[kept].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [lists, *(batch.column(c) for c in _STATE)], ["bins", *_STATE]
            )

    entries = vector_entries("features")
    read = rows.select(entries["place"].alias("places"), entries["value"].alias("values"), *_STATE)
    return read.mapInArrow(place, "bins array<int>, target double, weight double, margin double")


def is_local(rows: DataFrame) -> bool:
    """Whether one task may hold all binned rows."""
    return rows.count() <= LOCAL_ROWS and (rows.agg(F.sum(F.size("bins"))).first()[0] or 0) <= LOCAL_ENTRIES


_STATE = ("target", "weight", "margin")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the lists, the first being 0, and all their elements."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.flatten().to_numpy()


# --- One tree ---------------------------------------------------------------

class Grower:
    """Grows trees over binned rows."""

    def __init__(self, rows: DataFrame, layout: Layout):
        context = rows.sparkSession.sparkContext
        # With tasks for every so many rows, and bins that grow with the rows, sums would grow with their square.
        self.rows, self.layout = rows.coalesce(PASSES_PER_CORE * context.defaultParallelism), layout
        self.feature = layout.feature
        self.shared, self.most_blocks = context.broadcast(layout), BLOCKS_PER_CORE * context.defaultParallelism

    def close(self) -> None:
        self.shared.unpersist()

    def _passed(self, before: Sequence[tuple[float, Walk]], first: bool, tree: Walk | None):
        """Batches as (weight, what a tree is to learn, node, row and bin of every entry), or without a tree
        as (batch, margin)."""
        shared, before = self.shared, list(before)
        walks = [walk for _, walk in before] + ([] if tree is None else [tree])

        def read(batches: Iterator[pa.RecordBatch]):
            feature, zero = shared.value.feature, shared.value.zero
            asked = asked_bins(walks, feature, len(zero))
            for batch in batches:
                if not batch.num_rows:
                    continue
                ends, flat = _flat(batch.column("bins"))
                row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                # Of the many entries of a row the trees ask for a few: these are looked up once.
                kept = np.flatnonzero(asked[flat])
                few, of_row = flat[kept], row[kept]
                target, weight, margin = (batch.column(c).to_numpy() for c in _STATE)
                for share, walk in before:
                    margin = margin + share * walk.said[walk.reached(few, of_row, batch.num_rows, feature, zero)]
                y = 2 * target - 1
                with np.errstate(over="ignore"):
                    left = y if first else 4 * y / (1 + np.exp(2 * y * margin))
                node = None if tree is None else tree.reached(few, of_row, batch.num_rows, feature, zero)
                yield (batch, margin) if tree is None else (weight, left, node, row, flat)

        return read

    def with_margin(self, before: Sequence[tuple[float, Walk]]) -> DataFrame:
        """The binned rows, their margin moved on by the trees ``before``."""
        passed = self._passed(before, True, None)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, margin in passed(batches):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("bins"), batch.column("target"), batch.column("weight"), pa.array(margin)], ["bins", *_STATE]
                )

        return self.rows.mapInArrow(move, self.rows.schema)

    def _best(self, before, first: bool, tree: Tree, open_: list[int], drawn) -> list[tuple]:
        """(node, bin, gain, sums on the left) of the best split of every open leaf; the root's own sums are set."""
        passed, shared = self._passed(before, first, tree.walk()), self.shared
        n_bins, at_root = self.layout.n_bins, open_ == [0]
        blocks = min(1 + n_bins * len(open_) // BLOCK_CELLS, self.most_blocks)
        slot = np.full(len(tree.feature), -1)
        slot[open_] = np.arange(len(open_))
        sums = np.array([tree.sums[i] for i in open_])

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block_of = shared.value.feature % blocks  # frequent terms come first: they are dealt out in turn
            cells = len(open_) * n_bins
            whole = np.zeros((4, cells)) if cells <= DENSE_CELLS else None
            held: list[tuple] = []
            total = np.zeros(4)
            for weight, left, node, row, flat in passed(batches):
                each = (weight, weight * left, weight * left * left)
                if at_root:
                    total += [len(weight), *(part.sum() for part in each)]
                at = slot[node]
                live = at[row] >= 0
                row, flat = row[live], flat[live]
                keys = at[row] * n_bins + flat
                parts = (None, *(part[row] for part in each))
                if whole is not None:
                    for i, part in enumerate(parts):
                        whole[i] += np.bincount(keys, weights=part, minlength=cells)
                    continue
                held.append(_added(keys, *parts))
                if sum(len(h[0]) for h in held) > DENSE_CELLS:
                    yield from _dealt(held, block_of, n_bins)
                    held = []
            if whole is not None:
                keys = np.flatnonzero(whole[0])
                held = [(keys, *whole[:, keys])]
            yield from _dealt(held, block_of, n_bins)
            if total[0]:  # a cell of no bin, for every block
                cell = [pa.array([[v]] * blocks) for v in (-1, *total)]
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), *cell], ["block", *_CELLS])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, blocks_of = [], []
            for batch in batches:
                held.append([batch.column(c).flatten().to_numpy() for c in _CELLS])
                blocks_of.append(np.repeat(batch.column("block").to_numpy(), np.diff(batch.column("keys").offsets.to_numpy())))
            if not held:
                return
            keys, *parts = (np.concatenate(part) for part in zip(*held, strict=True))
            of_none, block, own, found = keys < 0, np.concatenate(blocks_of), sums, []
            if at_root:
                said = of_none & (block == block[of_none].min())
                own = np.array([[part[said].sum() for part in parts]])
                found = [(-1, -1, 0.0, *own[0])]
            cells = _merged(keys[~of_none], *(part[~of_none] for part in parts))
            found += zip(*best_splits(*cells, own, shared.value, drawn), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], list(_BEST)) if found else _none()

        types = [*("array<long>",), *["array<double>"] * 4]
        dealt = self.rows.mapInArrow(histogram, ", ".join(["block int", *(f"{c} {k}" for c, k in zip(_CELLS, types, strict=True))]))
        kept = dealt.repartitionById(blocks, F.col("block"))
        said = kept.mapInArrow(choose, ", ".join(f"{c} {k}" for c, k in _BEST.items())).toArrow()
        if at_root:
            own = said.filter(pc.less(said.column("node"), 0)).slice(0, 1)
            tree.sums[0] = np.array([own.column(c)[0].as_py() for c in "nwsq"]) if own.num_rows else np.zeros(4)
        said = said.filter(pc.greater_equal(said.column("node"), 0))
        best = _first_near(*(said.column(c).to_numpy() for c in _BEST))
        return [(open_[at], int(cut), float(gain), np.array(rest)) for at, cut, gain, *rest in zip(*best, strict=True)]

    def grow(self, before: Sequence[tuple[float, Walk]], first: bool, max_depth: int, feature_rate: float, seed: int) -> Tree:
        """One more tree after the trees ``before`` (weight, tree) that the rows' margin does not hold.

        Leaves of few rows are grown to the end in one last pass, if that saves passes and no
        features are drawn by a node's place.
        """
        tree, open_, apart = Tree(), [0], {}
        for depth in range(max(max_depth, 1)):
            drawn = _drawn(self.layout.n_features, feature_rate, seed, open_)
            grown = []
            for node, cut, gain, left in self._best(before, first, tree, open_, drawn):
                if gain <= EPSILON or depth == max_depth:
                    continue
                one, two = tree.split(node, int(self.feature[cut]), cut, gain)
                tree.sums[one], tree.sums[two] = left, tree.sums[node] - left
                grown += [one, two]
            open_ = [i for i in grown if tree.sums[i][0] > 1.5]
            to_come = max_depth - depth - 1
            few = [i for i in open_ if tree.sums[i][0] <= LOCAL_ROWS]
            if drawn is None and to_come > 1 and (to_come > LEVELS_APART or len(few) == len(open_)):
                apart |= dict.fromkeys(few, to_come)
                open_ = [i for i in open_ if i not in apart]
            if not open_:
                break
        if apart:
            self._finish(before, first, tree, apart)
        return tree

    def chain(
        self, before: Sequence[tuple[float, Walk]], n: int, upto: int, max_depth: int, feature_rate: float, seed: int, rate: float
    ) -> list[Tree]:
        """Trees ``n`` to ``upto`` of a chain (the first is 0), grown one after the other by one task.

        They are those of as many calls of :meth:`grow`; ``seed`` is the chain's, ``rate`` the weight
        of a tree after the first.  For rows that :func:`is_local` takes.
        """
        shared, before = self.shared, list(before)

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches, layout = [b for b in batches if b.num_rows], shared.value
            if not batches:
                return
            ends, flat = _flat(pa.concat_arrays([b.column("bins") for b in batches]))
            target, weight, margin = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in _STATE)
            rows, y = LocalRows(ends, flat, weight, layout), 2 * target - 1
            for share, walk in before:
                margin = margin + share * walk.said[walk.reached(rows.flat, rows.row, len(y), layout.feature, layout.zero)]
            for i in range(n, upto):
                with np.errstate(over="ignore"):
                    learned = y if i == 0 else 4 * y / (1 + np.exp(2 * y * margin))
                sums = rows.sums(learned)
                found, said = rows.grow(learned, max_depth, sums, lambda nodes: _drawn(layout.n_features, feature_rate, seed + i, nodes))
                margin = margin + (rate if i else 1.0) * said
                columns = zip(*[(i, -1, -1, -1, 0.0, *sums), *((i, step, *split) for step, split in enumerate(found))], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.float64() if t == "double" else pa.int64()) for c, t in zip(columns, _SPLIT.values(), strict=True)], list(_SPLIT)
                )

        said = self.rows.coalesce(1).mapInArrow(grow, ", ".join(f"{c} {t}" for c, t in _SPLIT.items())).toArrow()
        trees: dict[int, Tree] = {}
        for i, step, at, cut, gain, *left in zip(*(c.to_pylist() for c in said.sort_by([("root", "ascending"), ("step", "ascending")]).columns), strict=True):
            tree = trees.setdefault(i, Tree())
            if step < 0:
                tree.sums[0] = np.array(left)
                continue
            one, two = tree.split(at, int(self.feature[cut]), cut, gain)
            tree.sums[one], tree.sums[two] = np.array(left), tree.sums[at] - np.array(left)
        return [trees.get(i, Tree()) for i in range(n, upto)]

    def _finish(self, before, first: bool, tree: Tree, apart: dict[int, int]) -> None:
        """Grow every leaf of ``apart`` by its number of levels: its rows, at most ``LOCAL_ROWS``, go to one task."""
        passed, shared = self._passed(before, first, tree.walk()), self.shared
        wanted = np.zeros(len(tree.feature), dtype=bool)
        wanted[list(apart)] = True
        own = {i: (levels, tree.sums[i]) for i, levels in apart.items()}

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for weight, left, node, row, flat in passed(batches):
                live = wanted[node]
                sizes = np.bincount(row, minlength=len(node))[live]
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                bins = pa.ListArray.from_arrays(offsets, pa.array(flat[live[row]], pa.int32()))
                columns = [pa.array(node[live], pa.int32()), bins, pa.array(weight[live]), pa.array(left[live])]
                yield pa.RecordBatch.from_arrays(columns, ["node", "bins", "weight", "learned"])

        def grow(key: tuple, rows: pa.Table) -> pa.Table:
            node = key[0].as_py()
            rows = rows.combine_chunks()
            ends, flat = _flat(rows.column("bins").combine_chunks())
            weight, learned = (rows.column(c).to_numpy() for c in ("weight", "learned"))
            levels, sums = own[node]
            found, _ = LocalRows(ends, flat, weight, shared.value).grow(learned, levels, sums)
            columns = [np.full(len(found), node), np.arange(len(found)), *(np.array([f[k] for f in found]) for k in range(7))]
            return pa.table([pa.array(c, pa.float64() if t == "double" else pa.int64()) for c, t in zip(columns, _SPLIT.values(), strict=True)], list(_SPLIT))

        dealt = self.rows.mapInArrow(pick, "node int, bins array<int>, weight double, learned double")
        dealt = dealt.repartition(min(len(apart), self.most_blocks), "node")
        said = dealt.groupBy("node").applyInArrow(grow, ", ".join(f"{c} {t}" for c, t in _SPLIT.items())).toArrow()
        ids: dict[int, list[int]] = {}
        for root, _, at, cut, gain, *left in zip(*(c.to_pylist() for c in said.sort_by([("root", "ascending"), ("step", "ascending")]).columns), strict=True):
            known = ids.setdefault(root, [root])
            node = known[at]
            one, two = tree.split(node, int(self.feature[cut]), cut, gain)
            tree.sums[one], tree.sums[two] = np.array(left), tree.sums[node] - np.array(left)
            known += [one, two]


class LocalRows:
    """Rows of one task: trees grow on them without a pass over the table.

    ``flat`` up to each of ``ends`` are the bins of the rows' entries; they are held bin by bin.
    """

    def __init__(self, ends: np.ndarray, flat: np.ndarray, weight: np.ndarray, layout: Layout):
        self.layout, self.weight, self.root = layout, weight, None
        order = np.argsort(flat, kind="stable")
        self.flat = flat[order].astype(np.int32)
        self.row = np.repeat(np.arange(len(weight), dtype=np.int32), np.diff(ends))[order]
        self.of = layout.feature[self.flat].astype(np.int32)

    def sums(self, learned: np.ndarray) -> np.ndarray:
        """Of all rows: their number, weight, weighted sum and sum of squares."""
        each = (self.weight, self.weight * learned, self.weight * learned * learned)
        return np.array([len(learned), *(part.sum() for part in each)], dtype=float)

    def grow(
        self, learned: np.ndarray, levels: int, sums: np.ndarray, draw: Callable[[list[int]], Callable | None] | None = None
    ) -> tuple[list[tuple], np.ndarray]:
        """The splits below a leaf that holds the rows, and what is said of each row in the end.

        A split is (leaf, bin, gain, sums on the left), in the order they are made: the leaf is
        0, and each split numbers its left and its right on.  ``sums`` are the leaf's own,
        ``draw`` gives the features that the open leaves may split on.
        """
        layout, each = self.layout, (None, self.weight, self.weight * learned, self.weight * learned * learned)
        flat, row, of = self.flat, self.row, self.of
        tree, found, open_ = Tree(), [], [0]
        tree.sums[0] = sums
        node = np.zeros(len(learned), dtype=np.int64)
        for _ in range(levels):
            own = np.array([tree.sums[i] for i in open_])
            if not found:
                cells = self.root = self.root or Cells(flat, row, of, np.zeros(len(flat), dtype=np.int16), own, self.weight, layout)
            else:  # some rows may be done; the others' entries come leaf by leaf, bin by bin
                slot = np.full(len(tree.feature), -1, dtype=np.int16 if len(open_) < 1 << 15 else np.int64)
                slot[open_] = np.arange(len(open_))
                at = slot[node][row]
                live = np.flatnonzero(at >= 0)
                live = live[np.argsort(at[live], kind="stable")]
                flat, row, of, at = (x[live] for x in (flat, row, of, at))
                cells = Cells(flat, row, of, at, own, self.weight, layout)
            parents = []
            for place, cut, gain in zip(*cells.best(each[2], own[:, 2], draw(open_) if draw else None), strict=True):
                if gain > EPSILON:
                    parents.append(open_[place])
                    found.append((parents[-1], int(cut), float(gain)))
                    tree.split(parents[-1], int(layout.feature[cut]), int(cut), float(gain))
            if not parents:
                break
            node = tree.walk().step(node, flat, row, of, layout.zero)
            added = [np.bincount(node, weights=part, minlength=len(tree.feature)) for part in each]
            for i, parent in enumerate(parents, start=len(found) - len(parents)):
                one, two = tree.left[parent], tree.right[parent]
                tree.sums[one] = np.array([part[one] for part in added], dtype=float)
                tree.sums[two] = tree.sums[parent] - tree.sums[one]
                found[i] += tuple(tree.sums[one].tolist())
            open_ = [i for parent in parents for i in (tree.left[parent], tree.right[parent]) if tree.sums[i][0] > 1.5]
            if not open_:
                break
        return found, tree.walk().said[node]


class Cells:
    """What of the sums of a level hangs on its rows only, and not on what a tree learns.

    Entries come in the order of their leaf and bin: those of one leaf and bin are a cell, the
    cells of one leaf and feature a run.  What a run lacks of its leaf lies in its bin of zero.
    A split comes after a cell or after the bin of zero.
    """

    def __init__(self, flat, row, of, at, sums: np.ndarray, weight: np.ndarray, layout: Layout):
        self.row = row
        self.starts = _starts(at, flat)
        if not len(row):
            return
        n, w = np.diff(np.append(self.starts, len(row))).astype(float), np.add.reduceat(weight[row], self.starts)
        slot, bin_, feature = at[self.starts].astype(np.int64), flat[self.starts].astype(np.int64), of[self.starts]
        self.runs = _starts(slot, feature)
        self.slot, self.of_run = slot[self.runs], feature[self.runs]
        length = np.diff(np.append(self.runs, len(slot)))
        # Cells to which the one before is added, step by step.
        self.steps = [self.runs[length > step] + step for step in range(1, length.max())]
        rest_n, rest_w = (self._rest(part, sums[:, i]) for i, part in enumerate((n, w)))
        past = bin_ > layout.zero[feature]
        self._summed(n, w)
        # After a cell; the last one of a run past zero leaves nothing on the right.
        kept = bin_ < layout.last[feature]
        kept[self.runs + length - 1] &= ~past[self.runs + length - 1]
        cell = np.flatnonzero(kept)
        run = np.repeat(np.arange(len(self.runs)), length)[cell]
        over = past[cell].astype(float)
        left_n, left_w = n[cell] + over * rest_n[run], w[cell] + over * rest_w[run]
        valid = (left_n > 0.5) & (sums[self.slot[run], 0] - left_n > 0.5)
        self.cell, self.run, self.over, left_w, bins = (x[valid] for x in (cell, run, over, left_w, bin_[cell]))
        # After the bin of zero.
        below = np.add.reduceat((~past).astype(np.int64), self.runs)
        before_n, before_w = (self._before(part, below) for part in (n, w))
        zero_n = before_n + rest_n
        valid = (rest_n > 0.5) & (zero_n > 0.5) & (sums[self.slot, 0] - zero_n > 0.5) & (layout.zero[self.of_run] < layout.last[self.of_run])
        self.zero, self.below = np.flatnonzero(valid), below
        self.left = np.concatenate([left_w, (before_w + rest_w)[self.zero]])
        self.of_split = np.concatenate([self.run, self.zero])
        self.node = self.slot[self.of_split]
        self.bins = np.concatenate([bins, layout.zero[self.of_run[self.zero]]])
        self.right = sums[self.node, 1] - self.left
        self.factor = self.left * self.right / (self.left + self.right) ** 2

    def _rest(self, part: np.ndarray, own: np.ndarray) -> np.ndarray:
        return own[self.slot] - np.add.reduceat(part, self.runs)

    def _summed(self, *parts: np.ndarray) -> None:
        for at in self.steps:
            for part in parts:
                part[at] += part[at - 1]

    def _before(self, part: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Sums of each run's cells below zero."""
        return np.where(below > 0, part[np.maximum(self.runs + below - 1, 0)], 0.0)

    def best(self, learned: np.ndarray, own: np.ndarray, drawn=None) -> tuple[np.ndarray, ...]:
        """(leaf's place, bin, gain) of the best splits, as :func:`best_splits`; ``learned`` is weighted, ``own`` its sums."""
        if not len(self.row) or not len(self.node):
            return (), (), ()
        s = np.add.reduceat(learned[self.row], self.starts)
        rest = self._rest(s, own)
        self._summed(s)
        left = np.concatenate([s[self.cell] + self.over * rest[self.run], (self._before(s, self.below) + rest)[self.zero]])
        gain = self.factor * (left / self.left - (own[self.node] - left) / self.right) ** 2
        found = (self.node, self.bins, gain)
        if drawn is not None:
            may = np.zeros(len(self.runs), dtype=bool)
            begun = _starts(self.slot)
            for one, two in zip(begun, [*begun[1:], len(may)], strict=True):
                may[one:two] = drawn(self.slot[one])[self.of_run[one:two]]
            found = tuple(x[may[self.of_split]] for x in found)
        return _first_near(*found)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where any of ``keys`` changes, the first place among them."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    return np.flatnonzero(new)


_SPLIT = {"root": "long", "step": "long", "at": "long", "cut": "long", "gain": "double", "n": "double", "w": "double", "s": "double", "q": "double"}
_CELLS = ("keys", "n", "w", "s", "q")
_BEST = {"node": "long", "bin": "long", "gain": "double", "n": "double", "w": "double", "s": "double", "q": "double"}


def _drawn(n_features: int, rate: float, seed: int, nodes: list[int]):
    """Which features each node may split on: a function of the node's place, or None for all."""
    if rate >= 1:
        return None
    most = int(np.ceil(rate * n_features))

    def mask(place: int) -> np.ndarray:
        allowed = np.zeros(n_features, dtype=bool)
        allowed[np.random.default_rng([seed, nodes[place]]).permutation(n_features)[:most]] = True
        return allowed

    return mask


def _none() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], pa.int64() if k == "long" else pa.float64()) for k in _BEST.values()], list(_BEST))


def _added(keys: np.ndarray, *parts: np.ndarray | None) -> tuple:
    """One entry per key, ascending; None counts."""
    found, at = np.unique(keys, return_inverse=True)
    return (found, *(np.bincount(at, weights=part, minlength=len(found)).astype(float) for part in parts))


def _merged(keys: np.ndarray, *parts: np.ndarray) -> tuple:
    """:func:`_added` of keys that come in ascending runs, which sorting them stably makes use of."""
    if not len(keys):
        return (keys, *parts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[starts], *(np.add.reduceat(part[order], starts) for part in parts))


def _dealt(held: list[tuple], block_of: np.ndarray, n_bins: int) -> Iterator[pa.RecordBatch]:
    """Cells as one row a block of features."""
    if not held:
        return
    cells = held[0] if len(held) == 1 else _added(*(np.concatenate(part) for part in zip(*held, strict=True)))
    block = block_of[cells[0] % n_bins]
    order = np.argsort(block, kind="stable")
    names, starts = np.unique(block[order], return_index=True)
    offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(part[order])) for part in cells]
    yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *lists], ["block", *_CELLS])


def best_splits(keys, n, w, s, q, sums: np.ndarray, layout: Layout, drawn=None) -> tuple[np.ndarray, ...]:
    """The best split of each node over the features of ``keys`` (node * bins + bin, ascending).

    ``sums`` are the nodes' own; what a feature's cells lack of them lies in its bin of zero.
    """
    feature, zero, n_bins = layout.feature, layout.zero, layout.n_bins
    node, of = keys // n_bins, feature[keys % n_bins]
    if drawn is not None:
        kept = np.zeros(len(keys), dtype=bool)
        places, begun = np.unique(node, return_index=True)
        for place, one, two in zip(places, begun, [*begun[1:], len(node)], strict=True):
            kept[one:two] = drawn(place)[of[one:two]]
        keys, n, w, s, q, node, of = (x[kept] for x in (keys, n, w, s, q, node, of))
    if not len(keys):
        return tuple(np.zeros(0, dtype=np.int64 if t == "long" else float) for t in _BEST.values())
    starts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (of[1:] != of[:-1])))
    rest = [sums[node[starts], i] - np.add.reduceat(part, starts) for i, part in enumerate((n, w, s, q))]
    there = rest[0] > 0.5
    extra = (node[starts] * n_bins + zero[of[starts]])[there]
    keys = np.concatenate([keys, extra])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    left = [np.concatenate([part, r[there]])[order] for part, r in zip((n, w, s, q), rest, strict=True)]
    bins = keys % n_bins
    node, of = keys // n_bins, feature[bins]
    new = np.append(True, (node[1:] != node[:-1]) | (of[1:] != of[:-1]))
    # Sums up to each cell within its node and feature, cell by cell: MAX_BINS steps at most.
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(keys)))
    for step in range(1, lengths.max()):
        at = starts[lengths > step] + step
        for part in left:
            part[at] += part[at - 1]
    right = [sums[node, i] - part for i, part in enumerate(left)]
    valid = (bins < layout.last[of]) & (left[0] > 0.5) & (right[0] > 0.5)
    keys, node, bins = keys[valid], node[valid], bins[valid]
    (n, w, s, q), (_, w2, s2, _) = ([x[valid] for x in part] for part in (left, right))
    gain = w * w2 / (w + w2) ** 2 * (s / w - s2 / w2) ** 2
    return _first_near(node, bins, gain, n, w, s, q)


def _first_near(node, bins, gain, *more) -> tuple[np.ndarray, ...]:
    """Per node the lowest bin of those whose gain is the highest, but for rounding."""
    if not len(node):
        return node, bins, gain, *more
    highest = np.zeros(node.max() + 1)
    np.maximum.at(highest, node, gain)
    near = np.flatnonzero(gain >= highest[node] * (1 - ALIKE))
    order = near[np.lexsort((bins[near], node[near]))]
    picked = order[np.append(True, np.diff(node[order]) > 0)]
    return tuple(x[picked] for x in (node, bins, gain, *more))
