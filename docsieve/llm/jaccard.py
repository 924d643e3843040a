"""N-gram Jaccard join in a metric space: documents are sets of word shingles, linked
at a Jaccard similarity of 0.8 or more (distance up to ``EPS`` = 0.2).

Most documents lie at distance 1 from every other, where no pivot tells them apart,
so pivots are found cell by cell.  Each set is cut into buckets by the hashes of its
shingles, more buckets than two linked sets of that size can differ in: linked sets
agree in a whole bucket and share its cell.  The member of smallest key is the cell's
pivot, and a pivot's region is made of all cells it leads.  Then:

1. a contraction of the metric space drops members without a possible partner in their
   region: sets are counted into buckets, and the sum of the differences of two such
   lists is never more than the sets' symmetric difference;
2. every document joins the region of its nearest pivot (the one it shares most cells
   with), and regions are joined exactly, each in one task;
3. components of these links settle all regions that lie in one component; every other
   region is joined in full, pairs within a component being left out.

Inside a region the distances to its pivot give triangle-inequality windows: only
documents whose distances differ by ``EPS`` or less are compared, and further pivots
take the rest, smallest component first.  A region too large for a task is split
around pivots of its own, a document going to its nearest pivot and to every other
that is no more than ``2 * EPS`` farther (boundary replication), over and over; what no
pivot can split is dealt out as pairs of blocks.  Nothing is capped or left out.

Sets are told apart by 64-bit hashes of shingles and of whole sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialise
from .registry import query, table
from .text import broadcast_within, row_key

SHINGLE = 5
EPS = 0.2
#: Shingles of all members that one task joins.
REGION_LIMIT = 4_000_000
#: Rows of ids that may be broadcast: 16 bytes each.
MAX_BROADCAST = 2_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PLACE = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1)) % 2**64 | 1 for i in range(16)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes.  Words are runs without ASCII white space, A-Z
    lower-cased; fewer words than a shingle are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    width = min(size, len(hashes))
    if not width:
        return hashes
    total = np.full(len(hashes) - width + 1, width, dtype=np.uint64) * _MIX[0]
    for i in range(width):
        total += _mixed(hashes[i : len(hashes) - width + 1 + i] + _PLACE[i]) * _PLACE[i]
    return np.unique(_mixed(total))


def set_key(shingles: np.ndarray) -> int:
    """A hash of the whole set, signed."""
    total = int(_mixed(shingles + _MIX[0]).sum(dtype=np.uint64)) + len(shingles) * int(_MIX[2])
    return int(_mixed(np.array([total % 2**64], dtype=np.uint64)).view(np.int64)[0])


@lru_cache(maxsize=1)
def _classes() -> list[int]:
    """First sizes of the size classes; linked sets lie in one class or in neighbouring ones."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 5 // 4 + 1)
    return starts


def cells(shingles: np.ndarray) -> np.ndarray:
    """Cells of a set, such that two different sets linked share at least one.

    Sets of up to ``s`` shingles, the larger in that size class, differ in at most
    ``2 * s / 9`` shingles if linked.  With ``spare`` more buckets than that and one,
    they agree in more than ``spare``; if all these were empty, both sets would have
    more than ``spare`` empty buckets, and such sets add cells for their smallest
    hashes, of which linked sets share one (prefix filter).
    """
    n, starts, out = len(shingles), _classes(), []
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    own = bisect_right(starts, n) - 1
    place, value = _mixed(shingles + _MIX[2]) >> np.uint64(32), _mixed(shingles ^ _MIX[0])
    for c in (own, own + 1):
        if c > own and 4 * starts[c] > 5 * n:
            break  # no set of that class is near enough in size
        differ = 2 * (starts[c + 1] - 1) // 9
        if not differ:
            continue  # only equal sets are linked
        spare = differ // 12 + 1
        buckets = differ + 1 + spare
        bucket = (place * np.uint64(buckets)) >> np.uint64(32)
        sums = np.zeros(buckets, dtype=np.uint64)
        np.add.at(sums, bucket.astype(np.int64), value)
        used = np.flatnonzero(np.bincount(bucket.astype(np.int64), minlength=buckets))
        salt, more = (np.uint64((c + 1) * int(_PLACE[i]) % 2**64) for i in (3, 5))
        out.append(_mixed(_mixed(sums[used] + salt) + used.astype(np.uint64) * _MIX[0]))
        if buckets - len(used) > spare:
            out.append(_mixed(shingles[: n - -(-4 * n // 5) + 1] + more))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def sketch(shingles: np.ndarray) -> bytes:
    """Shingles counted into buckets, one for every two shingles or so, a power of two."""
    width = max(8, 1 << (max(len(shingles) // 2, 1) - 1).bit_length())
    place = (_mixed(shingles + _MIX[1]) & np.uint64(width - 1)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=width), 255).astype(np.uint8).tobytes()


def near_members(keys: np.ndarray, size: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Which members of a region may be linked to another: their sizes are near enough and
    their sketches differ by no more than linked sets can."""
    width = np.array([len(s) for s in sketches])
    lists = {w: np.stack([np.frombuffer(s, np.uint8) for s in sketches if len(s) == w]).astype(np.int16) for w in np.unique(width)}
    rows = {w: np.flatnonzero(width == w) for w in lists}

    def folded(counts: np.ndarray, w: int) -> np.ndarray:
        return counts if counts.shape[1] == w else np.minimum(counts.reshape(len(counts), -1, w).sum(axis=1, dtype=np.int16), 255)

    near = np.zeros(len(keys), dtype=bool)
    at = {w: {r: i for i, r in enumerate(found.tolist())} for w, found in rows.items()}
    for q in range(len(keys)):
        if near[q]:
            continue
        own = lists[width[q]][at[width[q]][q]][None]
        for w in (width[q] // 2, width[q], width[q] * 2):
            if w not in rows:
                continue
            others = rows[w]
            alike = np.flatnonzero((5 * size[others] >= 4 * size[q]) & (4 * size[others] <= 5 * size[q]) & (keys[others] != keys[q]))
            common = min(w, width[q])
            for i in range(0, len(alike), max(1, (1 << 22) // w)):
                some = alike[i : i + max(1, (1 << 22) // w)]
                apart = np.abs(folded(lists[w][some], common) - folded(own, common)).sum(axis=1, dtype=np.int64)
                hits = others[some[9 * apart <= size[q] + size[others[some]]]]
                if len(hits):
                    near[hits] = near[q] = True
    return near


def _sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row_key, n, key, sketch) of each row; an empty document has no key."""
    rows = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [shingle_set(t.as_py(), size) for t in batch.column(2)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "row_key": batch.column(1),
                "n": pa.array([len(s) for s in found], pa.int64()),
                "key": pa.array([set_key(s) if len(s) else None for s in found], pa.int64()),
                "sketch": pa.array([sketch(s) if len(s) else None for s in found], pa.binary()),
            })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, row_key long, n long, key long, sketch binary")


def _cells_of(docs: DataFrame, size: int) -> DataFrame:
    """(cell, key) of each set; a task leaves out the copies of a set it has seen."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in stream:
            found, keys, rows = [], [], 0
            for text in batch.column(0):
                shingles = shingle_set(text.as_py(), size)
                if len(shingles) and (key := set_key(shingles)) not in seen:
                    seen.add(key)
                    found.append(cells(shingles))
                    keys.append(key)
                    rows += len(found[-1])
                if rows > 500_000:
                    yield _cell_batch(found, keys)
                    found, keys, rows = [], [], 0
            yield _cell_batch(found, keys)

    return docs.select(F.col("text").cast("string")).mapInArrow(batches, "cell long, key long")


def _cell_batch(found: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
    cell = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
    key = np.repeat(np.array(keys, dtype=np.int64), [len(c) for c in found])
    return pa.RecordBatch.from_pydict({"cell": pa.array(cell.view(np.int64)), "key": pa.array(key)})


def _members(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, n, shingles) of the wanted sets (key, id, text_key), read from one document each."""
    few = broadcast_within(wanted, wanted.count(), MAX_BROADCAST)
    rows = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    rows = rows.join(few, rows["doc_id"].eqNullSafe(few["id"]) & (rows["row_key"] == few["text_key"])).select("key", "text")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({
                "key": batch.column(0), "n": pa.array([len(s) for s in found], pa.int64()),
                "shingles": pa.array(found, pa.list_(pa.int64())),
            })

    return rows.mapInArrow(batches, "key long, n long, shingles array<long>")


def _overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, Callable[[int, np.ndarray], np.ndarray]]:
    """Sizes of the sets, and a function: how many elements set ``q`` shares with each of ``others``."""
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    starts = ends - size
    flag = np.zeros(int(ids.max()) + 1, dtype=bool)

    def shared(q: int, others: np.ndarray) -> np.ndarray:
        flag[ids[starts[q] : ends[q]]] = True
        if 4 * len(others) > len(sets):
            found = np.add.reduceat(flag[ids], starts, dtype=np.int64)[others]
        else:
            found = np.array([np.count_nonzero(flag[ids[starts[i] : ends[i]]]) for i in others], dtype=np.int64)
        flag[ids[starts[q] : ends[q]]] = False
        return found

    return size, shared


def count_links(sets: list[np.ndarray], copies: np.ndarray, blocks: np.ndarray, cross: bool, before: list[list[int]]) -> np.ndarray:
    """Links of each set within a region, every linked set counted by its copies.

    ``before`` are the pivots smaller than the region's own that each set reaches: a pair
    that shares one is counted there.  If ``cross``, only sets of different blocks are paired.
    """
    size, shared = _overlaps(sets)
    out = np.zeros(len(sets), dtype=np.int64)
    reached: dict[int, list[int]] = {}
    for i, pivots in enumerate(before):
        for p in pivots:
            reached.setdefault(p, []).append(i)
    places = {p: np.array(found) for p, found in reached.items() if len(found) > 1}
    lead = shared(0, np.arange(len(sets)))
    distance = 1 - lead / (size[0] + size - lead)
    for q in range(len(sets) - 1):
        near = (5 * size >= 4 * size[q]) & (4 * size <= 5 * size[q]) & (np.abs(distance - distance[q]) <= EPS + 1e-9)
        near[: q + 1] = False
        if cross:
            near &= blocks != blocks[q]
        for p in before[q]:
            if p in places:
                near[places[p]] = False
        others = np.flatnonzero(near)
        if len(others):
            common = shared(q, others)
            linked = others[100 * common >= 80 * (size[q] + size[others] - common)]
            out[q] += copies[linked].sum()
            out[linked] += copies[q]
    return out


def link_region(keys: list[int], parts: list[int], sets: list[np.ndarray], pivot: int) -> list[tuple[int, int]]:
    """Links that connect the parts of one region as far as its links do.

    ``parts`` are component labels; pairs within a part are not looked at.  ``pivot``
    is the place of the region's first pivot.
    """
    size, shared = _overlaps(sets)
    label = np.unique(np.array(parts), return_inverse=True)[1]
    live, links = np.ones(len(keys), dtype=bool), []

    def take(q: int, others: np.ndarray, common: np.ndarray) -> None:
        for i in others[100 * common >= 80 * (size[q] + size[others] - common)]:
            if label[i] != label[q]:
                links.append((keys[q], keys[i]))
                label[label == label[i]] = label[q]

    everyone = np.arange(len(keys))
    common = shared(pivot, everyone)
    distance = 1 - common / (size[pivot] + size - common)
    take(pivot, everyone, common)
    live[pivot] = False
    while True:
        left, counts = np.unique(label[live], return_counts=True)
        if len(left) < 2:
            return links
        q = int(np.flatnonzero(live & (label == left[np.argmin(counts)]))[0])
        live[q] = False
        near = np.abs(distance - distance[q]) <= EPS + 1e-9
        alike = (5 * size >= 4 * size[q]) & (4 * size <= 5 * size[q])
        others = np.flatnonzero(live & near & alike & (label != label[q]))
        if len(others):
            take(q, others, shared(q, others))


def _regions(stream: Iterator[pa.RecordBatch], read) -> Iterator[list[tuple]]:
    """Members of one region after the other from rows sorted by region, their first column;
    ``read`` makes a batch's columns into lists."""
    now, members = None, []
    for batch in stream:
        region, columns = batch.column(0).to_numpy(), read(batch)
        for i, row in enumerate(zip(*columns)):
            if region[i] != now:
                if len(members) > 1:
                    yield members
                now, members = region[i], []
            members.append(row)
    if len(members) > 1:
        yield members


def _near_only(rows: DataFrame) -> DataFrame:
    """Rows (region, pivot, key, n, sketch) that may be linked within their region, as (pivot, key)."""
    dealt = rows.select("region", "pivot", "key", "n", "sketch").repartition("region").sortWithinPartitions("region")

    def read(batch: pa.RecordBatch) -> list:
        return [batch.column(i).to_pylist() for i in (1, 2, 3, 4)]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for members in _regions(stream, read):
            pivot, key, n, sketches = zip(*members)
            keep = near_members(np.array(key), np.array(n), list(sketches))
            out += [(pivot[i], key[i]) for i in np.flatnonzero(keep)]
            if len(out) > 100_000:
                yield _pairs_batch(out, "pivot", "key")
                out = []
        yield _pairs_batch(out, "pivot", "key")

    return dealt.mapInArrow(batches, "pivot long, key long")


def _join_regions(rows: DataFrame) -> DataFrame:
    """(a, b): links inside each region of (region, pivot, key, part, shingles); a region is
    one task's work, read as a stream of regions."""
    dealt = rows.select("region", "pivot", "key", "part", "shingles").repartition("region").sortWithinPartitions("region")

    def read(batch: pa.RecordBatch) -> list:
        lists = batch.column(4)
        values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sets = [values[low:high].copy() for low, high in zip(offsets[:-1], offsets[1:])]
        return [*(batch.column(i).to_pylist() for i in (1, 2, 3)), sets]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple] = []
        for members in _regions(stream, read):
            once = {key: (part, own) for _, key, part, own in members}
            keys, lead = list(once), members[0][0]
            if len(keys) > 1:
                parts, sets = zip(*once.values())
                links += link_region(keys, list(parts), list(sets), keys.index(lead) if lead in once else 0)
            if len(links) > 100_000:
                yield _pairs_batch(links, "a", "b")
                links = []
        yield _pairs_batch(links, "a", "b")

    return dealt.mapInArrow(batches, "a long, b long")


def set_links(reach: DataFrame, members: DataFrame, copies: DataFrame, limit: int) -> DataFrame:
    """(key, links): documents of other sets that each set is linked with, from every pair of
    ``reach`` (pivot, key), ``members`` (key, n, shingles) and ``copies`` (key, copies).

    Linked sets reach a common pivot and are verified once, in the region of the smallest.
    Regions beyond ``limit`` shingles are dealt out as pairs of blocks.
    """
    pivots = reach.groupBy("key").agg(F.sort_array(F.collect_set("pivot")).alias("pivots"))
    rows = reach.select("pivot", "key").join(pivots, "key").join(members, "key").join(copies, "key")
    rows = rows.withColumn("before", F.filter("pivots", lambda p: p < F.col("pivot"))).drop("pivots")
    sizes = reach.join(members.select("key", "n"), "key").groupBy("pivot").agg(F.sum("n").alias("total"), F.count("*").alias("sets"))
    blocks = F.when(F.col("total") > limit, F.ceil(2 * F.col("total") / limit)).otherwise(1).cast("int")
    rows = rows.join(sizes.where("sets > 1").select("pivot", blocks.alias("blocks")), "pivot")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = rows.select(
        F.xxhash64("pivot", low, high).alias("region"), "pivot", "key", "block", (low != high).alias("cross"), "copies", "before", "shingles"
    ).repartition("region").sortWithinPartitions("region")

    def read(batch: pa.RecordBatch) -> list:
        lists = batch.column(7)
        values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sets = [values[at:end].copy() for at, end in zip(offsets[:-1], offsets[1:])]
        return [*(batch.column(i).to_pylist() for i in range(2, 7)), sets]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members in _regions(stream, read):
            once = {row[0]: row for row in members}  # a repeated row is read twice
            keys, block, cross, copies, before, sets = zip(*once.values())
            found = count_links(list(sets), np.array(copies), np.array(block), cross[0], list(before))
            held = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.array(keys)[held]), "links": pa.array(found[held])})

    return dealt.mapInArrow(batches, "key long, links long").groupBy("key").agg(F.sum("links").alias("links"))


def _pairs_batch(pairs: list[tuple], first: str, second: str) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({first: pa.array(both[:, 0]), second: pa.array(both[:, 1])})


def deal_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (region, key, n, ...) with regions of over ``limit`` shingles cut into blocks of
    half of that, dealt out as pairs of blocks: every two members still meet."""
    sizes = rows.groupBy("region").agg(F.sum("n").alias("total")).where(F.col("total") > limit)
    blocks = materialise(sizes.select("region", F.ceil(2 * F.col("total") / limit).cast("int").alias("blocks")), "blocks")
    if blocks.isEmpty():
        return rows
    dealt = rows.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    return rows.join(blocks, "region", "left_anti").unionByName(dealt.withColumn("region", pair).select(rows.columns))


def split_regions(rows: DataFrame, limit: int = REGION_LIMIT, pivots: int = 16, levels: int = 3) -> DataFrame:
    """``rows`` (region, pivot, key, part, n, shingles) with regions of over ``limit`` shingles
    split so that every pair within ``EPS`` still meets in one."""
    done = []
    for level in range(levels):
        sizes = rows.groupBy("region").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
        big = materialise(sizes.where(F.col("total") > limit), "regions")
        if big.isEmpty():
            break
        done.append(rows.join(big.select("region"), "region", "left_anti"))
        large = rows.join(big.select("region", "members"), "region")
        # About ``pivots`` members by hash, as many for a region of any size.
        chosen = large.where(F.pmod(F.xxhash64("key", F.lit(level)), F.col("members")) < pivots)
        leaders = chosen.groupBy("region").agg(
            F.collect_list(F.struct(F.col("key").alias("lead"), F.col("shingles").alias("own"))).alias("leads")
        )
        far = F.transform("leads", lambda x: F.struct(
            (1 - F.size(F.array_intersect(x["own"], "shingles"))
             / F.size(F.array_union(x["own"], "shingles"))).alias("d"), x["lead"].alias("lead")))
        placed = large.join(leaders, "region", "left").withColumn("far", far).withColumn("home", F.array_min("far")["d"])
        window = F.filter("far", lambda x: x["d"] <= F.col("home") + 2 * EPS + 1e-9)
        spread = placed.withColumn("at", F.explode_outer(window))
        rows = materialise(
            spread.select(
                F.coalesce(F.xxhash64("region", "at.lead"), F.col("region")).alias("region"),
                F.coalesce("at.lead", "pivot").alias("pivot"), "key", "part", "n", "shingles",
            ),
            "split",
        )
    dealt = deal_blocks(rows, limit)
    for part in done:
        dealt = dealt.unionByName(part.select(dealt.columns))
    return dealt


def components(links: DataFrame) -> DataFrame:
    """(key, part): the smallest key that links lead to, for every linked key.

    Each round takes the smallest label among neighbours, then the label's own label;
    rounds are written to the shared folder and end when no label changes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.distinct(), "links")
    labels = materialise(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("part")).select(F.col("a").alias("key"), "part"), "labels")
    while True:
        seen = edges.join(labels.withColumnsRenamed({"key": "b"}), "b").groupBy("a").agg(F.min("part").alias("near"))
        lower = labels.join(seen.withColumnRenamed("a", "key"), "key").select(
            "key", F.col("part").alias("before"), F.least("part", "near").alias("part")
        )
        lower = materialise(lower, "labels")
        jump = lower.select(F.col("key").alias("part"), F.col("part").alias("next"))
        after = lower.join(jump, "part").select("key", F.least("part", "next").alias("part"), "before")
        after = materialise(after, "labels")
        changed = not after.where("part <> before").isEmpty()
        discard(labels, lower)
        labels = after.select("key", "part")
        if not changed:
            discard(edges)
            return labels


def jaccard_components(docs: DataFrame, size: int = SHINGLE, limit: int = REGION_LIMIT, links: bool = False) -> DataFrame:
    """One row per input row of (doc_id, text): doc_id, row_key (hash of the text),
    n_shingles, key (of the set), component_key and component_id, the smallest doc_id
    of all documents that links lead to.

    Documents without words are linked with nothing: their keys are null and their
    component is themselves.  Equal sets are linked.  Null ids are never the smallest; a
    component of nothing else has a null id.  Repeated rows come back repeated.  Other
    columns are not read.

    Components need only links that connect them.  With ``links`` every pair is verified
    and n_links, the number of other rows that a row is linked with, is added.
    """
    docs = docs.select("doc_id", "text")
    sets = materialise(_sets_of(docs, size), "sets")
    whole = Window.partitionBy("cell")
    shared = _cells_of(docs, size).withColumns({"pivot": F.min("key").over(whole), "last": F.max("key").over(whole)})
    shared = shared.where("pivot <> last").groupBy("pivot", "key").agg(F.count("*").alias("cells"))
    reach = materialise(shared, "reach")  # every pivot reaches itself

    keys = reach.select("key").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("text_key")))
    each = sets.where("key IS NOT NULL").groupBy("key").agg(first.alias("first"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    known = materialise(each.join(keys, "key").select("key", "first.id", "first.text_key", "n", "sketch"), "known")
    all_ = reach.join(known.select("key", "n", "sketch"), "key").withColumn("region", F.col("pivot"))
    near = _near_only(deal_blocks(all_.select("region", "pivot", "key", "n", "sketch"), limit)).distinct()
    reached_all, reach = reach, materialise(near.join(reach, ["pivot", "key"]), "near")
    wanted = known.select("key", "id", "text_key").join(reach.select("key").distinct(), "key")
    wanted = materialise(wanted, "wanted")
    members = materialise(_members(docs, wanted, size), "members")
    discard(reached_all, known, wanted)

    # The nearest pivot's region, and each pivot in its own; chunks of a large region are joined by its pivot.
    nearest = reach.where("pivot <> key").groupBy("key").agg(F.max_by("pivot", F.struct("cells", "pivot")).alias("pivot"))
    home = nearest.join(members.select("key", "n"), "key")
    chunks = F.ceil(F.sum("n") / limit).cast("int")
    parts = home.groupBy("pivot").agg(chunks.alias("chunks"))
    placed = home.join(parts, "pivot").select("pivot", "key", F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk"))
    leads = parts.select("pivot", F.col("pivot").alias("key"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    placed = placed.unionByName(leads).select(F.xxhash64("pivot", "chunk").alias("region"), "pivot", "key", F.col("key").alias("part"))
    near = materialise(_join_regions(placed.join(members, "key")), "links")

    # Regions that these links leave in several components.
    settled = components(near)
    reached = reach.select("pivot", "key").join(settled, "key", "left").withColumn("part", F.coalesce("part", "key"))
    open_ = reached.groupBy("pivot").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    rest = reached.join(open_.select("pivot"), "pivot").select(F.col("pivot").alias("region"), "pivot", "key", "part")
    rest = materialise(rest.join(members, "key"), "open")
    more = materialise(_join_regions(split_regions(rest, limit)), "links")

    found = components(near.unionByName(more))
    counted = None
    if links:
        copies = sets.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"))
        others = set_links(reach, members, copies, limit)
        counted = copies.join(others, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        counted = materialise(counted, "counted")
    discard(reach, members, near, settled, rest, more)
    smallest = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("smallest"))
    grouped = smallest.join(found, "key", "left").withColumn("part", F.coalesce("part", "key"))
    heads = grouped.groupBy("part").agg(F.min("smallest").alias("component_id"))
    of_key = grouped.join(heads, "part").select("key", F.col("part").alias("component_key"), "component_id")
    if counted is not None:
        of_key = of_key.join(counted, "key")
    filled = sets.join(of_key, "key", "left")
    return filled.select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), "key", "component_key",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []),
    )


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest doc_id, then of smallest
    text hash.  Documents without words all stay."""
    found = materialise(jaccard_components(docs, size).where("key IS NOT NULL"), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("text"))
    heads = found.groupBy("component_key").agg(F.min(order).alias("head"), F.count("*").alias("rows")).where("rows > 1")
    marked = found.join(heads, "component_key").withColumn("is_head", order.eqNullSafe(F.col("head")))
    drop = materialise(marked.where(~F.col("is_head")).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct(), "drop")
    twice = marked.where("is_head").groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).count()
    twice = materialise(twice.where("count > 1").drop("count"), "twice")

    def same(other: DataFrame):
        return docs["doc_id"].eqNullSafe(other["_id"]) & (row_key(docs["text"]) == other["_key"])

    drop = broadcast_within(drop, drop.count(), MAX_BROADCAST)
    twice = broadcast_within(twice, twice.count(), MAX_BROADCAST)
    discard(found)
    kept = docs.join(drop, same(drop), "left_anti")
    again = docs.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same(twice), "left_anti").unionByName(again)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach ON d.doc_id = reach.x GROUP BY d.doc_id
"""


@query("op1_ngram_jaccard", SQL)
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


LINKS_SQL = SQL.replace("min(reach.y) AS component_id", "min(reach.y) AS component_id, (SELECT count(*) FROM links l WHERE l.x = d.doc_id)::BIGINT AS n_links")


@query("op1_jaccard_links", LINKS_SQL)
def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), links=True)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")
