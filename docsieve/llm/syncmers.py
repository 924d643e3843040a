"""Document fingerprints from closed syncmers.

A substring of K code points is an anchor if the least of its substrings of S code points
(by hash) stands at one of its edges.  Whether it is one depends on nothing around it, so
the same passage has the same anchors in every text, wherever it stands: two texts are
compared by the anchors they share in the same order.  Of K - S + 1 = 32 places two make
an anchor, one in 16, and any 31 successive substrings of a text hold at least one.

A fingerprint lists all anchors, hash and place, in the order of the text.  All work is on
whole texts, a batch of texts at a time in array operations.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialise
from .registry import query, table

K, S = 40, 9
SPAN = K - S + 1  # 32
#: Code points worked on at once.
BLOCK = 1 << 20
#: Rows whose keys are looked at to cut the order of documents into sections.
SAMPLE = 100_000
#: Bytes of text in a section, about.
SECTION_BYTES = 64 << 20
_BASE, _GOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _GOLD
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _window_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all substrings of S and of K code points (polynomials modulo 2^64)."""
    hashes = {1: _mixed(points.astype(np.uint64) + _BASE)}

    def joined(a: int, b: int) -> np.ndarray:
        left, right = hashes[a], hashes[b][a:]
        n = min(len(left), len(right))
        return left[:n] * _power(b) + right[:n]

    for size in (1, 2, 4, 8, 16):
        hashes[2 * size] = joined(size, size)
    return _mixed(joined(8, 1)), _mixed(joined(32, 8))


def _sliding_least(values: np.ndarray) -> np.ndarray:
    """Least of every SPAN successive values."""
    size = 1
    while size < SPAN:
        values, size = np.minimum(values[: len(values) - size], values[size:]), 2 * size
    return values


class Fingerprint(NamedTuple):
    """Anchors in the order of the text."""

    hashes: np.ndarray  # uint32
    places: np.ndarray  # uint32

    def encoded(self) -> str:
        """The hashes, then the places, as base64 of little-endian 32-bit numbers; "" of an empty text."""
        return base64.b64encode(self.hashes.astype("<u4").tobytes() + self.places.astype("<u4").tobytes()).decode()

    @staticmethod
    def decoded(text: str) -> Fingerprint:
        both = np.frombuffer(base64.b64decode(text), "<u4")
        return Fingerprint(both[: len(both) // 2], both[len(both) // 2 :])


def fingerprints(texts: list[np.ndarray]) -> list[Fingerprint]:
    """Fingerprints of texts given as arrays of code points (uint32).

    A text without an anchor, which is shorter than K + SPAN - 2 code points, is one anchor
    itself; an empty text has none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    whole = np.concatenate(texts) if texts else np.empty(0, np.uint32)
    place = key = np.empty(0, np.int64)
    if len(whole) >= K:
        inner, outer = _window_hashes(whole)
        least = _sliding_least(inner)
        place = np.flatnonzero((inner[: len(least)] == least) | (inner[SPAN - 1 :] == least))
        text = np.searchsorted(ends, place, "right")
        inside = place + K <= ends[text]  # not across the edge of two texts
        place, text = place[inside], text[inside]
        key = (outer[place] >> np.uint64(32)).astype(np.uint32)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    else:
        cuts = np.zeros(len(texts) + 1, np.int64)
    out = []
    for i, points in enumerate(texts):
        lo, hi = cuts[i], cuts[i + 1]
        if hi > lo:
            out.append(Fingerprint(key[lo:hi], (place[lo:hi] - starts[i]).astype(np.uint32)))
        elif len(points):
            digest = hashlib.sha256(points.astype("<u4").tobytes()).digest()[:4]
            out.append(Fingerprint(np.frombuffer(digest, "<u4"), np.zeros(1, np.uint32)))
        else:
            out.append(Fingerprint(np.empty(0, np.uint32), np.empty(0, np.uint32)))
    return out


def _occurrences(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, order): keys tell the first, second, ... anchor of one hash apart and ascend;
    ``order`` is where each stands."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order].astype(np.uint64)
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.flatnonzero(new)
    nth = np.arange(len(ranked)) - first[np.cumsum(new) - 1]
    return (ranked << np.uint64(32)) | nth.astype(np.uint64), order


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Twice the anchors that both hold in one order, over all anchors of both: 0 to 1.

    The n-th anchor of a hash is matched with the other's n-th; of the matches the longest
    chain that ascends in both texts counts.  Two empty texts are alike.
    """
    total = len(a.hashes) + len(b.hashes)
    if not total:
        return 1.0
    if not len(a.hashes) or not len(b.hashes):
        return 0.0
    left, at = _occurrences(a.hashes)
    right, to = _occurrences(b.hashes)
    where = np.searchsorted(left, right)
    found = left[np.minimum(where, len(left) - 1)] == right
    pairs = at[where[found]], to[found]
    return 2 * _longest_chain(pairs[1][np.argsort(pairs[0])]) / total


def _longest_chain(values: np.ndarray) -> int:
    """Length of the longest ascending subsequence of different numbers."""
    if len(values) < 2 or (values[1:] > values[:-1]).all():
        return len(values)
    from bisect import bisect_left

    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def code_points(text: bytes | None) -> np.ndarray:
    """Code points of UTF-8; bytes that are none become U+FFFD; null is empty."""
    return np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _utf8(points: np.ndarray) -> bytes:
    return points.astype("<u4").tobytes().decode("utf-32-le").encode()


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint), one row per input row, without any shuffle.

    A null or empty text has the fingerprint "".  Bytes that are no UTF-8 count as U+FFFD.
    Equal texts have equal fingerprints; null and repeated ids stay as they are; an empty
    table stays empty; other columns are not read.
    """
    columns = docs.select(docs[id].alias("k"), docs[text].cast("string").cast("binary").alias("t"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = 0
            for texts in _blocks(code_points(v.as_py()) for v in batch.column(1)):
                found = [f.encoded() for f in fingerprints(texts)]
                yield pa.RecordBatch.from_pydict({
                    "k": batch.column(0).slice(at, len(texts)), "n_chars": pa.array(map(len, texts), pa.int64()),
                    "fingerprint": pa.array(found, pa.string()),
                })
                at += len(texts)

    schema = f"k {columns.schema['k'].dataType.simpleString()}, n_chars long, fingerprint string"
    return columns.mapInArrow(batches, schema).withColumnRenamed("k", id)


def _blocks(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    block, size = [], 0
    for points in texts:
        block.append(points)
        size += len(points)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


# --- Each text against the next ---------------------------------------------

def _sections(docs: DataFrame, keys: tuple[str, ...], size: int) -> tuple[list[tuple], list[tuple]]:
    """(cuts, heads): keys that cut the order of the rows into about ``size`` sections, and the
    first key of each section that holds rows.  There are at most SAMPLE of either."""
    least = docs.orderBy(F.xxhash64(*keys)).limit(SAMPLE if size > 1 else 0)
    sample = sorted(tuple(r) for r in least.select(*keys).collect())
    cuts = sorted({sample[len(sample) * i // size] for i in range(1, size)} if sample else set())
    placed = docs.select(*keys, _section(cuts)(*keys).alias("section"))
    heads = placed.groupBy("section").agg(F.min(F.struct(*keys)).alias("head")).orderBy("section").collect()
    return cuts, [(r["section"], *r["head"]) for r in heads]


def _section(cuts: list[tuple]):
    """Arrow function from the keys of rows to the number of cuts at or below them."""
    columns = [np.array(c, np.int64) for c in zip(*cuts)] if cuts else None

    @F.arrow_udf("int")
    def section(missing: pa.Array, id: pa.Array, tie: pa.Array) -> pa.Array:
        if columns is None:
            return pa.array(np.zeros(len(id)), pa.int32())
        rows = [np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (missing, id, tie)]
        n = len(columns[0])
        # Cuts come before rows of the same key, so a row's place among them counts the cuts up to it.
        order = np.lexsort((np.r_[np.zeros(n), np.ones(len(id))], *(np.r_[c, r] for c, r in zip(columns[::-1], rows[::-1]))))
        below = np.empty(len(order), np.int64)
        below[order] = np.cumsum(order < n)
        return pa.array(below[n:], pa.int32())

    return section


def compare_with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", sections: int | None = None) -> DataFrame:
    """Each text beside its edited form and the next document, one row per input row:
    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one after it in ascending ``id``, the first after the last.
    In the edited text the last floor(n_chars / 2) code points are replaced by the first as
    many (or all) of the next document.  ``near_edited`` and ``near_next`` are the likeness
    of a text's fingerprint to that of its edited text and of the next document.

    Ids are whole numbers; null ids come last, rows of one id in the order of a hash of
    their text.  A null text is empty.  Bytes that are no UTF-8 count as U+FFFD.  A single
    row is followed by itself; an empty table stays empty; other columns are not read.

    The order is cut into sections at keys of a bounded sample, which steers only their
    size; a section is sorted in one task, and the first row of each is dealt out a second
    time, to end the section before it.  Texts are moved once.
    """
    spark = docs.sparkSession
    keys = ("missing", "id", "tie")
    rows = docs.select(docs[id].cast("long").alias("k"), docs[text].cast("string").alias("t")).select(
        F.col("k").isNull().cast("int").alias("missing"), F.coalesce("k", F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce("t", F.lit(""))).alias("tie"), "k", F.col("t").cast("binary").alias("t"),
    )
    known = materialise(rows.select(*keys, F.octet_length("t").alias("bytes")), "keys")
    if sections is None:
        size = known.agg(F.sum("bytes")).first()[0] or 0
        sections = max(1, -(-size // SECTION_BYTES), min(4 * spark.sparkContext.defaultParallelism, size >> 20))
    cuts, heads = _sections(known, keys, sections)
    discard(known)
    if not heads:
        return spark.createDataFrame([], f"{id} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # The head of a section is also sent to the section before it, that of the first to the last.
    schema = "missing int, id long, tie long, before int"
    twice = spark.createDataFrame([(*h[1:], heads[i - 1][0]) for i, h in enumerate(heads)], schema)
    guards = F.broadcast(twice).join(rows, [*keys], "inner")
    own = rows.withColumns({"section": _section(cuts)(*keys), "guard": F.lit(False)})
    # Copies of a head are alike: one of them is enough.
    sent = guards.select(*keys, "k", "t", F.col("before").alias("section"), F.lit(True).alias("guard")).dropDuplicates(["section"])
    dealt = own.unionByName(sent).repartition(max(len(heads), 1), "section").sortWithinPartitions("section", "guard", *keys)
    return dealt.select("section", "guard", "k", "t").mapInArrow(
        _pairs, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumnRenamed("k", id)


def _pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row but the guard that ends its section, with the row after it."""
    waiting: list[tuple] = []  # rows in order; the last has not met its next one yet
    size = 0
    for batch in stream:
        for section, guard, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), (v.as_py() for v in batch.column(3))):
            points = code_points(text)
            waiting.append((section, guard, key, points))
            size += len(points)
            if size >= BLOCK // 2:
                yield _compared(waiting)
                waiting, size = waiting[-1:], len(points)
    if waiting:
        yield _compared(waiting)


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    own = fingerprints([r[3] for r in rows])
    pairs = [i for i in range(len(rows) - 1) if not rows[i][1]]
    edited = []
    for i in pairs:
        points, after = rows[i][3], rows[i + 1][3]
        half = len(points) // 2
        edited.append(np.concatenate([points[: len(points) - half], after[:half]]))
    others = [f for block in _blocks(iter(edited)) for f in fingerprints(block)]
    return pa.RecordBatch.from_pydict({
        "k": pa.array([rows[i][2] for i in pairs], pa.int64()),
        "n_chars": pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(_utf8(e)).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array([own[i].encoded() for i in pairs], pa.string()),
        "edited_fingerprint": pa.array([f.encoded() for f in others], pa.string()),
        "near_edited": pa.array([likeness(own[i], f) for i, f in zip(pairs, others)], pa.float64()),
        "near_next": pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
    })


@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
