"""License scans: an exact set-similarity join of text blocks with license notices.

A block is a run of ``block`` words from any word on, a notice is a set of words.  A
notice is found in every block that holds at least ``threshold`` of its distinct words.
Texts are cut into stretches of ``block`` starts, each with all words its blocks reach.
The words of all notices are ordered by their document frequency in the whole corpus,
rarest first.  A stretch with a block that reaches the threshold must hold one of the
notice's ``m - need + 1`` rarest words (prefix filter), have ``need`` words of the notices
at all (length filter), and enough words left after the first shared one on both sides
(positional filter); what is left is verified block by block.

Fixed phrases are found beside it, with their places.  All of it is column
expressions; the join side that is broadcast are the notices, a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .text import alnum_words, row_key

PHRASES: Mapping[str, str] = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Public notices of common licenses, by label, as words.
NOTICES: Mapping[str, tuple[str, ...]] = {
    "agpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "apache": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "cc-by": (
        "this work is licensed under the creative commons attribution 4 0 international license",
        "licensed under cc by 4 0",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "cc-by-sa": (
        "this work is licensed under the creative commons attribution sharealike 4 0 international license",
        "licensed under cc by sa 4 0",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this work is licensed under the gnu general public license version 3",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "released under the mit license",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
}
THRESHOLD = 0.9
#: Words of a block, not fewer than any notice has.
BLOCK = 160


def notice_sets(notices: Mapping[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(text.split()))) for label, texts in sorted(notices.items()) for text in texts]


def document_frequency(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents of (w) that hold each word of the vocabulary; at most as many rows as it has words."""
    held = words.select(F.explode_outer(F.array_intersect("w", _texts(vocabulary))).alias("word")).where("word IS NOT NULL")
    found = {r.word: r["count"] for r in held.groupBy("word").count().collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def places(words: str | Column, phrases: Mapping[str, str] = PHRASES) -> Column:
    """Sorted (start, label) of every place where a phrase's words stand consecutively, words counted from 0."""
    words = F.col(words) if isinstance(words, str) else words
    none = F.array().cast("array<struct<start:int,label:string>>")
    found = [
        F.when(F.array_contains(words, phrase.split()[-1]), _places_of(words, phrase.split(), label)).otherwise(none)
        for phrase, label in phrases.items()
    ]
    return F.sort_array(F.concat(none, *found))


def _places_of(words: Column, phrase: list[str], label: str) -> Column:
    ends = F.filter(
        F.transform(words, lambda w, i: F.when(w == phrase[-1], i)), lambda i: i >= len(phrase) - 1
    )
    for back, word in enumerate(reversed(phrase[:-1]), 1):
        ends = _preceded(ends, words, back, word)
    return F.transform(ends, lambda i: F.struct((i - (len(phrase) - 1)).alias("start"), F.lit(label).alias("label")))


def _preceded(ends: Column, words: Column, back: int, word: str) -> Column:
    return F.filter(ends, lambda i: F.get(words, i - back) == word)


def scan_licenses(
    docs: DataFrame,
    notices: Mapping[str, tuple[str, ...]] = NOTICES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """Licenses of each document of (doc_id, text), one row per input row:
    doc_id, n_words, places (of the phrases), found (sorted ``(label, block,
    containment)`` of the notices: of each ``block`` consecutive starts, counted from the
    text's first word, the block that holds most of the notice, the first of equal ones;
    ``block`` is its first word, one of the notice's, from 0).

    Null and empty texts have nothing; repeated rows give repeated results; without
    notices only the phrases are looked for.  A text may hold several notices' words, as
    that of a weak copyleft holds nearly all of the strong one's: each is found.  Other
    columns are not read.
    """
    longest = max((len(t.split()) for texts in notices.values() for t in texts), default=1)
    if longest > block:
        raise ValueError(f"a notice of {longest} words does not fit blocks of {block} words")
    words = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), alnum_words("text").alias("w"))
    sets = notice_sets(notices)
    vocabulary = sorted({w for _, ws in sets for w in ws})
    seen = document_frequency(words, vocabulary) if vocabulary else {}
    by_rank = sorted(vocabulary, key=lambda w: (seen[w], w))
    order = {w: i for i, w in enumerate(by_rank)}
    ranked = [(label, sorted(ws, key=order.get)) for label, ws in sets]
    need = [math.ceil(threshold * len(ws) - 1e-9) for _, ws in ranked]
    index = [
        (w, i, label, ws, n, len(ws) - at) for i, ((label, ws), n) in enumerate(zip(ranked, need))
        for at, w in enumerate(ws[: len(ws) - n + 1])
    ]
    rare = _texts(sorted({row[0] for row in index}))
    spark = docs.sparkSession
    indexed = spark.createDataFrame(index, "prefix string, notice int, label string, words array<string>, need int, left int")

    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(block))
    reach = 2 * block - 1  # words of the blocks that start in one stretch
    cut = F.transform(
        F.filter(starts, lambda s: F.arrays_overlap(F.slice("w", s + 1, F.lit(reach)), rare)),
        # The words of notices in a stretch, in their order: an intersection keeps that of its first side.
        lambda s: F.struct(
            s.alias("at"), F.slice("w", s + 1, F.lit(reach)).alias("w"),
            F.array_intersect(_texts(by_rank), F.slice("w", s + 1, F.lit(reach))).alias("held"),
        ),
    )
    # Texts without any of the rarest words have no stretch to look at.
    near = F.filter(F.when(F.arrays_overlap("w", rare), cut), lambda b: F.size(b["held"]) >= min(need, default=1))
    kind = "array<struct<at:int,w:array<string>,held:array<string>>>"
    marker = F.array(F.lit(None)).cast(kind)
    near = F.concat(marker, F.coalesce(near, F.array().cast(kind)))
    base = words.select("doc_id", "row_key", F.size("w").alias("n_words"), places("w", phrases).alias("places"), near.alias("b"))
    rows = base.select("doc_id", "row_key", "n_words", "places", F.posexplode_outer("b").alias("n", "block"))
    probes = rows.select(
        "doc_id", "row_key", "n_words", F.when(F.col("n") == 0, F.col("places")).alias("places"), "n", "block",
        F.explode_outer(F.array_intersect("block.held", rare)).alias("probe"),
    )
    after = F.size("block.held") - F.array_position("block.held", F.col("probe")) + 1
    close = (F.col("probe") == F.col("prefix")) & (F.least(F.col("left"), after) >= F.col("need"))
    met = probes.join(F.broadcast(indexed), close, "left").where("n = 0 OR notice IS NOT NULL")
    # A notice is verified once a stretch: at the first word they share.
    shared = F.array_intersect("words", "block.held")
    open_ = (F.element_at(shared, 1) == F.col("probe")) & (F.size(shared) >= F.col("need"))
    best = F.when(open_, _best_block(F.col("block.w"), F.col("words"), block))
    hit = F.struct("label", (F.col("block.at") + F.col("best.at")).alias("block"), (F.col("best.n") / F.size("words")).alias("containment"))
    met = met.withColumn("best", best).withColumn("hit", F.when(F.col("best.n") >= F.col("need"), hit))
    per_row = met.groupBy("doc_id", "row_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("copies"),
        F.max("places").alias("places"),
        F.collect_set("hit").alias("found"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return per_row.select("doc_id", "n_words", "places", F.sort_array("found").alias("found"), each.alias("copy")).drop("copy")


def _best_block(stretch: Column, words: Column, block: int) -> Column:
    """(n, at) of the block of a stretch that holds most of ``words``, the first of equal ones.

    A block loses nothing if it starts at the first of these words in it."""
    marked = F.transform(stretch, lambda w, i: F.struct(i.alias("at"), F.when(F.array_contains(words, w), w).alias("word")))
    hits = F.filter(marked, lambda h: h["word"].isNotNull())

    def held(start: Column) -> Column:
        inside = F.filter(hits, lambda h: (h["at"] >= start["at"]) & (h["at"] < start["at"] + block))
        return F.struct(F.size(F.array_distinct(inside["word"])).alias("n"), (-start["at"]).alias("back"))

    top = F.array_max(F.transform(F.filter(hits, lambda h: h["at"] < block), held))
    return F.struct(top["n"].alias("n"), (-top["back"]).alias("at"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_PHRASES = ", ".join(f"({_sql_list(p.split())}, '{label}')" for p, label in PHRASES.items())
_NOTICES = ", ".join(
    f"('{label}', {_sql_list(ws)}, {len(ws)}, {math.ceil(THRESHOLD * len(ws) - 1e-9)})" for label, ws in notice_sets(NOTICES)
)
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
phrases(p, label) AS (VALUES {_PHRASES}),
places AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS start
  FROM d, phrases WHERE list_contains(w, p[-1])),
base AS (SELECT doc_id, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY doc_id),
notices(label, words, m, need) AS (VALUES {_NOTICES}),
whole AS (SELECT doc_id, w, label, words, m, need FROM (SELECT *, list_distinct(w) AS once FROM d), notices WHERE len(list_intersect(once, words)) >= need),
starts AS (SELECT doc_id, w, label, words, m, need, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(words, w[i]))) AS s FROM whole),
met AS (SELECT doc_id, label, need, m, len(list_intersect(list_distinct(w[s:s + {BLOCK} - 1]), words)) AS n FROM starts),
found AS (SELECT doc_id, label, max(n / m::DOUBLE) AS share FROM met WHERE n >= need GROUP BY ALL),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM found UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""


@query("op9_license_scan", SQL)
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.transform("places", lambda p: p["label"])
    method = F.transform("found", lambda f: f["label"])
    best = F.array_max(F.transform("found", lambda f: f["containment"]))
    start = F.transform("places", lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, method))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
