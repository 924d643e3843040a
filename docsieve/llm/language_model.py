"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are counted first and stored as sorted arrays of their 64-bit hashes, one shard
for each leading byte; a word's id is its shard and place.  Bigrams are counted as
pairs of ids and stored as sorted arrays too.  Counts of counts, context totals and
numbers of distinct neighbours are sums over the bigrams of a shard, so no context,
however frequent, ever meets in one task.  Scoring tasks map the arrays from the
shared folder and look up sorted batches of words and pairs.

Every distinct bigram of the training texts is kept.  Words are told apart by their
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .registry import query, table
from .store import open_array, write_array

#: Shards of the bigram arrays.
SHARDS = 256
#: Tokens that a task counts, and scores, at a time.
BLOCK, SCORED = 1 << 20, 1 << 18
#: Markers for the start and the end of a text; white space is in no word.
START, END = (np.uint64(xxhash.xxh64_intdigest(b" " + m)) for m in (b"start", b"end"))


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words (runs without ASCII white space, A-Z lower-cased) and its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


def _blocks(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, tokens of each row) of runs of rows with about ``block`` tokens."""
    first, found, size = 0, [], 0
    for row, text in enumerate(texts):
        found.append(token_hashes(text.as_py()))
        size += len(found[-1])
        if size >= block:
            yield first, np.concatenate(found), np.array([len(f) for f in found])
            first, found, size = row + 1, [], 0
    if found:
        yield first, np.concatenate(found), np.array([len(f) for f in found])


def _before(tokens: np.ndarray, lengths: np.ndarray, start) -> np.ndarray:
    """Each token's predecessor, ``start`` for the first of a row."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(lengths) - lengths] = start
    return out


class Words:
    """The stored words: hash -> id (shard << 24 | place), and their arrays by id."""

    KINDS = {"hash": np.uint64, "count": np.int64, "p": np.float64, "total": np.int64, "rest": np.float64}

    def __init__(self, folder: str):
        self.folder = folder
        self.arrays: dict[tuple[str, int], np.ndarray] = {}

    def array(self, kind: str, shard: int) -> np.ndarray:
        if (kind, shard) not in self.arrays:
            self.arrays[kind, shard] = open_array(self.folder, f"{kind}-{shard}", self.KINDS[kind])
        return self.arrays[kind, shard]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes; -1 for words that were not counted."""
        ids = np.full(len(hashes), -1, dtype=np.int64)
        for shard, low, high in _runs((hashes >> np.uint64(56)).astype(np.int64)):
            stored, wanted = self.array("hash", shard), hashes[low:high]
            place = np.searchsorted(stored, wanted)
            known = place < len(stored)
            known[known] = stored[place[known]] == wanted[known]
            ids[low:high] = np.where(known, shard << 24 | place, -1)
        return ids

    def get(self, kind: str, ids: np.ndarray, default: float) -> np.ndarray:
        """Values of sorted ids, the default for -1 and where no text was counted."""
        out = np.full(len(ids), default, dtype=self.KINDS[kind])
        for shard, low, high in _runs(ids >> 24):
            if shard >= 0 and len(self.array(kind, shard)):
                out[low:high] = self.array(kind, shard)[ids[low:high] & 0xFFFFFF]
        return out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of runs of equal values."""
    if len(values):
        edges = np.flatnonzero(np.diff(values)) + 1
        for low, high in zip((0, *edges.tolist()), (*edges.tolist(), len(values))):
            yield int(values[low]), low, high


@lru_cache(maxsize=2)
def _words(folder: str) -> Words:
    return Words(folder)


def _by_shard(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, columns) of whole shards; the first column is the shard and sorted."""
    now, parts = None, []
    for batch in stream:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for shard, low, high in _runs(columns[0]):
            if shard != now and parts:
                yield now, [np.concatenate(c) for c in zip(*parts)]
                parts = []
            now = shard
            parts.append([c[low:high] for c in columns[1:]])
    if parts:
        yield now, [np.concatenate(c) for c in zip(*parts)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more.  Where a count
    of counts is missing, and outside their bounds, halves: 0.5, 1, 1.5."""
    if not all((n1, n2, n3, n4)):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k else k / 2 for k, d in enumerate(found, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that all scores share."""

    folder: str
    tokens: int
    words: int
    discounts: tuple[float, float, float]
    unknown: float
    shards: int


def train(docs: DataFrame, text: str = "text", shards: int = SHARDS) -> Model:
    """Count the texts and store the model below the shared folder.

    Null texts are empty and count one end.  Without rows the model knows nothing and
    gives every token probability 1.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "bigrams")
    texts = docs.select(F.col(text).cast("string").alias("t"))

    def count_words(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for _, tokens, _ in _blocks(batch.column(0)):
                found, n = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": pa.array(found.view(np.int64)), "n": pa.array(n)})

    counted = texts.mapInArrow(count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    start = spark.range(1).select(F.lit(int(START.view(np.int64))).alias("hash"), F.lit(0).cast("long").alias("n"))
    sharded = counted.unionByName(start).select(F.shiftrightunsigned("hash", 56).alias("shard"), "hash", "n")

    def store_words(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (hashes, n) in _by_shard(stream):
            hashes = hashes.view(np.uint64)
            order = np.argsort(hashes)
            if len(order) > 1 << 24:
                raise ValueError("more words than ids: over 2**24 in a shard")
            write_array(folder, f"hash-{shard}", hashes[order])
            write_array(folder, f"count-{shard}", n[order])
            yield pa.RecordBatch.from_pydict({"words": [int((n > 0).sum())], "tokens": [int(n.sum())]})

    dealt = sharded.repartition("shard").sortWithinPartitions("shard")
    sizes = materialise(dealt.mapInArrow(store_words, "words long, tokens long"), "words")
    size = sizes.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()

    def count_pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(folder)
        for batch in stream:
            for _, tokens, lengths in _blocks(batch.column(0)):
                distinct, place = np.unique(np.append(tokens, START), return_inverse=True)
                ids = words.find(distinct)[place]
                pair, n = np.unique(_before(ids[:-1], lengths, ids[-1]) << 32 | ids[:-1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(n)})

    pairs = texts.mapInArrow(count_pairs, "pair long, n long")
    low = F.col("pair").bitwiseAND(0xFFFFFFFF)
    shard = F.pmod(F.shiftrightunsigned("pair", 32) + low, F.lit(shards)).cast("int")
    pairs = pairs.select(shard.alias("shard"), "pair", "n").repartition("shard").groupBy("shard", "pair").agg(F.sum("n").alias("n"))

    def store_pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (pair, n) in _by_shard(stream):
            order = np.argsort(pair.view(np.uint64))
            pair, n = pair.view(np.uint64)[order], n[order]
            write_array(folder, f"pair-{shard}", pair)
            write_array(folder, f"pairs-{shard}", n if n.max() >= 2**32 else n.astype(np.uint32))
            context = (pair >> np.uint64(32)).astype(np.int64)
            heads = np.flatnonzero(np.diff(context, prepend=-1))
            word, before = np.unique((pair & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)

            def per_context(x: np.ndarray) -> np.ndarray:
                return np.concatenate([np.add.reduceat(x.astype(np.int64), heads), np.zeros(len(word), np.int64)])

            columns = {"id": np.concatenate([context[heads], word]), "total": per_context(n)}
            columns |= {f"n{k}": per_context(n == k) for k in (1, 2, 3, 4)} | {"more": per_context(n > 2)}
            columns["before"] = np.concatenate([np.zeros(len(heads), np.int64), before])
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    sums = ["total", "n1", "n2", "n3", "n4", "more", "before"]
    dealt = pairs.sortWithinPartitions("shard").mapInArrow(store_pairs, "id long, " + ", ".join(f"{c} long" for c in sums))
    stats = materialise(materialise(dealt, "pairs").groupBy("id").agg(*(F.sum(c).alias(c) for c in sums)), "contexts")
    whole = stats.agg(
        *(F.sum(c).alias(c) for c in sums),
        *(F.count(F.when(F.col("before") == k, 1)).alias(f"b{k}") for k in (1, 2, 3, 4)),
        F.count(F.when(F.col("before") > 2, 1)).alias("b_more"),
    ).first()
    d = discounts(whole.n1, whole.n2, whole.n3, whole.n4)
    low_d = discounts(whole.b1, whole.b2, whole.b3, whole.b4)
    kinds, words = whole.before or 0, size.words or 0
    rest = (low_d[0] * whole.b1 + low_d[1] * whole.b2 + low_d[2] * whole.b_more) / kinds if kinds else 1.0
    unknown = rest / (words + 1)

    def store_contexts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (ids, total, n1, n2, more, before) in _by_shard(stream):
            length = len(open_array(folder, f"hash-{shard}", np.uint64))
            place = ids & 0xFFFFFF
            own = before - np.choose(np.minimum(before, 3), [0.0, *low_d])
            values = {
                "p": np.where(before > 0, own / max(kinds, 1), 0.0) + unknown,
                "total": total,
                "rest": (d[0] * n1 + d[1] * n2 + d[2] * more) / np.maximum(total, 1),
            }
            for kind, found in values.items():
                out = np.full(length, unknown if kind == "p" else 0, dtype=Words.KINDS[kind])
                out[place] = found
                write_array(folder, f"{kind}-{shard}", out)
            yield pa.RecordBatch.from_pydict({"shard": [shard]})

    dealt = stats.select(F.shiftright("id", 24).alias("shard"), "id", "total", "n1", "n2", "more", "before")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(store_contexts, "shard long")
    materialise(dealt, "arrays")
    return Model(folder, size.tokens or 0, words, d, unknown, shards)


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, n_tokens, n_known (tokens seen in training), base_score (add-one
    unigram) and score (the model), both log10 of the text's probability, and perplexity.

    A null or empty text is its end alone.  One row per input row; other columns are not read.
    """
    columns = docs.select(F.col(text).cast("string").alias("t"), *(docs[c].alias(f"k{i}") for i, c in enumerate(keep)))
    pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pair_counts(found: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs, 0 for those that were not counted."""
        shard = ((found >> np.uint64(32)) + (found & np.uint64(0xFFFFFFFF))) % np.uint64(model.shards)
        order = np.lexsort((found, shard))
        out = np.zeros(len(found), dtype=np.int64)
        for s, low, high in _runs(shard[order].astype(np.int64)):
            if s not in pairs:
                keys, raw = open_array(model.folder, f"pair-{s}", np.uint64), open_array(model.folder, f"pairs-{s}", np.uint8)
                pairs[s] = keys, raw.view(np.int64 if len(raw) == 8 * len(keys) else np.uint32)
            stored, counts = pairs[s]
            wanted = found[order[low:high]]
            place = np.searchsorted(stored, wanted)
            known = place < len(stored)
            known[known] = stored[place[known]] == wanted[known]
            values = np.zeros(len(wanted), dtype=np.int64)
            values[known] = counts[place[known]]
            out[order[low:high]] = values
        return out

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(model.folder)
        d = np.array([0.0, *model.discounts])
        for batch in stream:
            for first, tokens, lengths in _blocks(batch.column(0), SCORED):
                distinct, place = np.unique(np.append(tokens, START), return_inverse=True)
                ids = words.find(distinct)
                # Sorted hashes have sorted ids within their shards, so the arrays are read in order.
                count = words.get("count", ids, 0)[place[:-1]]
                p = words.get("p", ids, model.unknown)[place[:-1]]
                total, rest = words.get("total", ids, 0), words.get("rest", ids, 0.0)
                before = _before(place[:-1], lengths, place[-1])
                h, w = ids[before], ids[place[:-1]]
                both = (h >= 0) & (w >= 0)
                pair, back = np.unique((h[both] << 32 | w[both]).view(np.uint64), return_inverse=True)
                n = np.zeros(len(w), dtype=np.int64)
                n[both] = pair_counts(pair)[back]
                seen = total[before]
                own = (n - d[np.minimum(n, 3)]) / np.maximum(seen, 1)
                p = np.where(seen > 0, own + rest[before] * p, p)
                starts = np.cumsum(lengths) - lengths
                base = np.log10((count + 1) / (model.tokens + model.words + 1))
                score = np.add.reduceat(np.log10(p), starts)
                kept = batch.slice(first, len(lengths))
                yield pa.RecordBatch.from_pydict(
                    {f"k{i}": kept.column(i + 1) for i in range(len(keep))}
                    | {
                        "n_tokens": pa.array(lengths.astype(np.int64)),
                        "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                        "base_score": pa.array(np.add.reduceat(base, starts)),
                        "score": pa.array(score),
                        "perplexity": pa.array(10 ** np.minimum(-score / lengths, 300)),
                    }
                )

    kept = "".join(f"k{i} {columns.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    schema = kept + "n_tokens long, n_known long, base_score double, score double, perplexity double"
    return columns.mapInArrow(batches, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    model = train(docs.where(~held_out))
    scored = score_texts(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity",
    )
