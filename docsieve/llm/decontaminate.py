"""Benchmark decontamination: normalised test n-grams as a broadcast hash set,
scanned by the windows of the training texts, hits verified word by word.

Each benchmark window is also filed under its longest word, its anchor, with that word's
place.  A text is cut into words once; the words leave the row through one generator, and
only around an anchor a window is hashed and looked up in the broadcast set, all in the
same stage.  Only windows found there, with their words, and one marker row a document go
on to a shuffle, where the words themselves are compared.  A benchmark of more windows than
may be broadcast is cut into several sets, each probed by a scan of its own, so the texts
are never shuffled whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .registry import query, table
from .text import alnum_words, broadcast_within, row_key

WINDOW = 13
#: Hashes of windows that may be broadcast at once, some 50 bytes each; also the rows of other small tables.
MAX_BROADCAST = 1_000_000


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k, hash, anchor, shift, gram, items): the distinct windows of (item_id, text), each
    with its number of words, the hash of all, the hash of its longest word and that word's
    place in it, counted from 0.

    An item of fewer words than a window is one window; one without words is none.
    Null item ids give windows that belong to no item.
    """
    cut = items.select(F.col("item_id").cast("string").alias("item"), alnum_words("text").alias("w"))
    size = F.size("w")
    k = F.least(size, F.lit(window))
    starts = F.when(size > 0, F.sequence(F.lit(1), size - k + 1))
    grams = cut.select("item", "w", k.alias("k"), F.explode(starts).alias("at"))
    grams = grams.select("item", F.slice("w", F.col("at"), F.col("k")).alias("gram"))
    found = grams.groupBy("gram").agg(F.collect_set("item").alias("items"))
    longest = F.array_max(
        F.transform("gram", lambda w, i: F.struct(F.length(w).alias("size"), F.xxhash64(w).alias("hash"), i.alias("i")))
    )
    return found.withColumn("longest", longest).select(
        F.size("gram").alias("k"), F.xxhash64("gram").alias("hash"), F.col("longest.hash").alias("anchor"),
        F.col("longest.i").alias("shift"), "gram", "items",
    )


def scan_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Hits of each document of (doc_id, text), one row per input row:
    doc_id, row_key (hash of the text), n_words, hits (sorted ``(at, span)``, words
    counted from 1), items (sorted item ids as text).

    Null texts have no words; repeated rows give repeated results; an empty
    benchmark hits nothing.  Other columns of either table are not read.
    """
    bench = materialise(benchmark_windows(items.select("item_id", "text"), window), "benchmark")
    blocks = max(1, -(-bench.count() // max(1, max_broadcast)))
    words = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), alnum_words("text").alias("w"))
    # Row 0 of each document is a marker; the rest are its words.
    marked = F.concat(F.array(F.lit("")), F.col("w"))
    rows = words.select("doc_id", "row_key", "w", F.posexplode_outer(marked).alias("n", "word"))

    def window_at(spot: Column) -> Column:
        at = F.col("n") - spot["shift"]
        gram = F.slice("w", F.greatest(at, F.lit(1)), spot["k"])
        return F.struct(at.alias("at"), spot["k"].alias("k"), F.xxhash64(gram).alias("hash"))

    def scanned(block: int) -> DataFrame:
        part = bench.where(F.pmod("hash", F.lit(blocks)) == block)
        anchors = part.groupBy("anchor").agg(F.collect_set(F.struct("shift", "k")).alias("spots"))  # 13 x 13 at most
        known = part.select("k", "hash").distinct().withColumn("known", F.lit(True))
        near = rows.join(F.broadcast(anchors), F.xxhash64("word") == F.col("anchor"), "left")
        near = near.where("n = 0 OR spots IS NOT NULL" if block == 0 else "n > 0 AND spots IS NOT NULL")
        # The marker is a window of no words; its hash only spreads the markers.
        mark = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.col("row_key").alias("hash")))
        fits = F.filter("spots", lambda s: (F.col("n") > s["shift"]) & (F.col("n") - s["shift"] + s["k"] - 1 <= F.size("w")))
        windows = F.when(F.col("n") == 0, mark).otherwise(F.transform(fits, window_at))
        met = near.select("doc_id", "row_key", "w", F.inline(windows)).join(F.broadcast(known), ["k", "hash"], "left")
        return met.where("at = 0 OR known").select(
            "doc_id", "row_key", F.col("at").alias("n"), "k", "hash", F.size("w").alias("n_words"),
            F.when(F.col("at") > 0, F.slice("w", F.greatest("at", F.lit(1)), F.col("k"))).alias("words"),
        )

    met = scanned(0)
    for block in range(1, blocks):
        met = met.unionByName(scanned(block))
    same = (met["k"] == bench["k"]) & (met["hash"] == bench["hash"]) & (met["words"] == bench["gram"])
    found = met.join(bench, same, "left").select(
        "doc_id", "row_key", "n_words", "n", F.when(F.col("gram").isNotNull(), F.struct(F.col("n").alias("at"), met["k"].alias("span"))).alias("hit"), "items"
    ).where("n = 0 OR hit IS NOT NULL")
    per_row = found.groupBy("doc_id", "row_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("copies"),
        F.collect_set("hit").alias("hits"),
        F.collect_set("items").alias("items"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return per_row.select(
        "doc_id", "row_key", "n_words", F.sort_array("hits").alias("hits"),
        F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"), each.alias("copy"),
    ).drop("copy")


def words_hit(hits: str | Column) -> Column:
    """Words covered by sorted ``(at, span)`` windows."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("next"))
    return F.aggregate(
        hits,
        start,
        lambda s, h: F.struct(
            (s["n"] + F.greatest(h["at"] + h["span"] - F.greatest(s["next"], h["at"].cast("bigint")), F.lit(0))).alias("n"),
            F.greatest(s["next"], (h["at"] + h["span"]).cast("bigint")).alias("next"),
        ),
        lambda s: s["n"],
    )


def contaminated(n_hit: str | Column, n_words: str | Column, share: int = 20) -> Column:
    """A document is contaminated if at least one word in ``share`` is hit."""
    n_hit, n_words = (F.col(c) if isinstance(c, str) else c for c in (n_hit, n_words))
    return (n_hit > 0) & (n_hit * share >= n_words)


def remove_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The clean rows of ``docs``, all columns kept."""
    hits = scan_documents(docs, items, window)
    bad = hits.where(contaminated(words_hit("hits"), "n_words", share)).select("doc_id", "row_key").distinct()
    bad = materialise(bad.withColumnsRenamed({"doc_id": "_bad_id", "row_key": "_bad_key"}), "contaminated")
    bad = broadcast_within(bad, bad.count(), MAX_BROADCAST)
    match = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (row_key(docs["text"]) == bad["_bad_key"])
    return docs.join(bad, match, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, mark: str = " ") -> DataFrame:
    """All rows of ``docs``; in texts with hits the words hit are replaced by ``mark`` and
    ``n_chars``, if there, is counted anew.  Characters between words stay."""
    hits = scan_documents(docs, items, window).where(F.size("hits") > 0)
    hits = materialise(hits.select(F.col("doc_id").alias("id"), "row_key", "hits").distinct(), "spans")
    whole = docs.select("text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    match = whole["row"]["doc_id"].eqNullSafe(hits["id"]) & (row_key(whole["text"]) == hits["row_key"])
    joined = whole.join(broadcast_within(hits, hits.count(), MAX_BROADCAST // 10), match, "left")
    word = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["span"] - 1))))
    parts = joined.select(
        "row", "text", covered.alias("covered"), F.split("text", word, -1).alias("gaps"),
        F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("words"),
    )
    kept = F.transform("words", lambda w, i: F.when(F.array_contains("covered", i + 1), F.lit(mark)).otherwise(w))
    pieces = F.zip_with("gaps", F.concat(kept, F.array(F.lit(""))), lambda g, w: F.concat(g, w))
    out = parts.select("row", F.when(F.col("covered").isNotNull(), F.array_join(pieces, "")).alias("clean"))
    return out.select(*(
        F.coalesce("clean", F.col("row.text")).alias(c) if c == "text"
        else F.coalesce(F.length("clean").cast("long"), F.col("row.n_chars")).alias(c) if c == "n_chars"
        else F.col("row")[c].alias(c)
        for c in docs.columns
    ))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM grams),
wins AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, wins.k, item FROM wins JOIN grams ON wins.gram = grams.gram AND wins.k = grams.k),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op3_decontaminate", SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    counted = hits.select("doc_id", F.col("n_words").cast("long"), words_hit("hits").alias("n_hit"), "items")
    return counted.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated("n_hit", "n_words").alias("contaminated"),
    )
