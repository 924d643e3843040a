"""Ranked lexical search in reverse: documents stream past the items' inverted index.

The items' terms, bounded in number, are broadcast as an inverted index; no index of the
documents is built.  A first pass cuts every document down to the counts of the terms it
shares with the items and writes them; the collection's figures are sums over that table.
A second pass takes it through the index and updates a heap of bounded size per item in
every task; the heaps are merged in two steps.  Item sets beyond the bound are cut into
blocks, each a broadcast of its own, so that any number of items is answered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .registry import query, table
from .text import LOWER, UPPER, alnum_words

#: (term, item) entries of a broadcast index.
MAX_ENTRIES = 1_000_000
#: Scores held at once, documents times items.
BLOCK = 1 << 21
#: First-level merges per item.
SALTS = 64
_GAPS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
#: Bytes of UTF-8: A-Z lower-cased, whatever stands between terms blank, all else as it is.
_PLAIN = bytes.maketrans(UPPER.encode() + _GAPS, LOWER.encode() + b" " * len(_GAPS))


class Index:
    """Terms of a block of items: a number for each term and, by number, the items that hold it."""

    def __init__(self, entries: list[tuple[str, int]]):
        terms = sorted({t for t, _ in entries})
        self.number = {t.encode(): i for i, t in enumerate(terms)}
        place = {t: i for i, t in enumerate(terms)}
        which = np.fromiter((place[t] for t, _ in entries), np.int64, len(entries))
        order = np.argsort(which, kind="stable")
        self.items = np.fromiter((i for _, i in entries), np.int64, len(entries))[order]
        self.starts = np.searchsorted(which[order], np.arange(len(terms) + 1))


class Heaps:
    """The ``k`` best (score, document) of every item: higher scores first, then smaller ids, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.null = np.empty(0, bool)
        self.least = np.ones(items, np.int64)  # what a document must reach to enter

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """``scores`` has a row for each document and a column for each item."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        item, score, id_, missing = (
            np.concatenate(x)
            for x in ((self.item, item), (self.score, scores[doc, item]), (self.id, ids[doc]), (self.null, null[doc]))
        )
        order = np.lexsort((id_, missing, -score, item))
        item, score, id_, missing = item[order], score[order], id_[order], missing[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        full, keep = rank == self.k - 1, rank < self.k
        self.least[item[full]] = score[full]
        self.item, self.score, self.id, self.null = item[keep], score[keep], id_[keep], missing[keep]


def count_terms(docs: DataFrame, index, id: str, text: str) -> DataFrame:
    """(id, n, terms, counts) of each document with at least one term: all its terms with
    repeats, and number and count of those in the broadcast ``index``."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.value.number
        for batch in stream:
            ids, sizes, terms, counts = [], [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (value.as_py() or b"").translate(_PLAIN).split()
                if words:
                    found = Counter(words)
                    known = found.keys() & number.keys()
                    ids.append(key)
                    sizes.append(len(words))
                    terms.append([number[w] for w in known])
                    counts.append([found[w] for w in known])
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()),
                "terms": pa.array(terms, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int64())),
            })

    columns = docs.select(docs[id].cast("long").alias("id"), docs[text].cast("string").cast("binary").alias("text"))
    return columns.mapInArrow(batches, "id long, n long, terms array<int>, counts array<long>")


def _search(counted: DataFrame, index, weights, n_docs: int, n_terms: int, items: int, k: int) -> DataFrame:
    """(item, score, id): at most ``k`` of each item from every task."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, holders, weight = index.value.starts, index.value.items, weights.value
        heaps, step = Heaps(items, k), max(1, BLOCK // max(items, 1))
        for batch in stream:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sizes = part.column(1).to_numpy()
                m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in sizes], np.int64)
                terms, counts = (part.column(c).flatten().to_numpy() for c in (2, 3))
                each = np.diff(part.column(2).offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), each)
                gain = weight[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m[doc]))
                scores = np.zeros((part.num_rows, items), np.int64)
                # An item has a term once and a document lists it once, so the places of one term differ.
                width = starts[terms + 1] - starts[terms]
                for lo, hi in _runs(width, BLOCK):
                    w = width[lo:hi]
                    offset = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                    holder = holders[np.repeat(starts[terms[lo:hi]], w) + offset]
                    np.add.at(scores.reshape(-1), np.repeat(doc[lo:hi], w) * items + holder, np.repeat(gain[lo:hi], w))
                ids = part.column(0)
                heaps.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(heaps.item), "score": pa.array(heaps.score), "id": pa.array(heaps.id, mask=heaps.null)
        })

    return counted.mapInArrow(batches, "item long, score long, id long")


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs whose sizes add up to about ``most``."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """(item, rank, id, score): each item's ``k`` highest-scoring documents with a score above 0.

    A null or empty text has no terms: such a document is in no count and no answer, such
    an item has no answer.  Texts are read whole.  Equal scores go by ascending id, null
    last.  Repeated rows count one by one: a document that is there twice may be returned
    twice, and an item that is there twice (or whose id is null) is answered twice.  An
    empty table on either side gives no rows.  Other columns are not read.  Ids of
    documents are whole numbers; ids of items are of any type.
    """
    spark = docs.sparkSession
    asked = items.select(items[item].alias("key"), F.array_distinct(alnum_words(items[text])).alias("terms"))
    asked = materialise(asked.where(F.size("terms") > 0).withColumn("uid", F.monotonically_increasing_id()), "items")
    whole = asked.agg(F.sum(F.size("terms")).alias("entries"), F.count("*").alias("items")).first()
    blocks = max(1, -(-(whole["entries"] or 0) // max_entries))
    while blocks > 1 and blocks < whole["items"]:  # hashing deals unevenly
        sizes = asked.groupBy(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("b")).agg(F.sum(F.size("terms")).alias("n"))
        if sizes.agg(F.max("n")).first()[0] <= max_entries:
            break
        blocks *= 2
    found = [
        _search_block(spark, docs, asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b), k, id, text, item)
        for b in range(blocks)
    ]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _search_block(spark, docs, asked, k, id, text, item) -> DataFrame:
    # The block is within the bound (a single item's terms at the least), so the driver can hold it.
    rows = asked.select("uid", "terms").orderBy("uid").collect()
    index = spark.sparkContext.broadcast(Index([(t, i) for i, r in enumerate(rows) for t in r["terms"]]))
    counted = materialise(count_terms(docs, index, id, text), "term-counts")
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.floor(1000 * F.log((F.lit(2.0) * total["docs"] + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weights = np.zeros(len(index.value.number), np.int64)
    for r in df.select("term", rarity.alias("w")).collect():  # as many as the index has terms
        weights[r["term"]] = r["w"]
    best = _search(
        counted, index, spark.sparkContext.broadcast(weights), total["docs"], total["terms"] or 1, len(rows), k
    ).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    for keys in (["item", "salt"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["uid"]) for i, r in enumerate(rows)], "item long, uid long")
    named = names.join(asked.select("uid", "key"), "uid").select("item", "key")
    return best.join(named, "item").select(
        F.col("key").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score"
    )


_TERMS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS du, doc_id, {_TERMS} AS w FROM documents),
sized AS MATERIALIZED (SELECT du, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, sum(n)::HUGEINT AS n_terms FROM sized),
items AS MATERIALIZED (SELECT row_number() OVER () AS iu, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
asked AS MATERIALIZED (SELECT iu, item_id, unnest(w) AS term FROM items),
tf AS MATERIALIZED (SELECT du, term, count(*) AS tf FROM (SELECT du, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY du, term),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
gain AS (SELECT tf.du, doc_id, tf.term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS gain
  FROM tf JOIN weight USING (term) JOIN sized USING (du), total),
scored AS (SELECT iu, item_id, du, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gain USING (term) GROUP BY iu, item_id, du, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY iu ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_lexical_search", SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
