"""Lexical search, hard negatives and fingerprints against plain versions, on nulls, empty and
long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import hard_negatives, lexical_search, syncmers
from tests.llm import plain

CLASH = "uid long, n long, q string, g int, s int, score string, rank string, tie long, guard string, section string"
FILL = (1, 2, "q", 3, 4, "x", "y", 5, "z", "w")


# --- Hard negatives -----------------------------------------------------------

def vectors(spark, rows):
    schema = f"vec_id long, label int, embedding array<float>, a boolean, {CLASH}"
    return spark.createDataFrame([(*r, *FILL) for r in rows], schema)


def as_rows(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def random_vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    return [[round(rng.gauss(0, spread) * 64) / 64 for _ in range(width)] for _ in range(n)]


def test_hard_negatives_equal_plain(spark):
    rows = [(i, i % 3, v, i % 5 == 0) for i, v in enumerate(random_vectors(120, 7, 1))]
    rows += [(0, 0, rows[0][2], True), (0, 0, rows[0][2], True)]  # an anchor three times
    rows += [(7, 1, rows[8][2], False), (500, 2, [0.0] * 7, True), (501, 2, [0.0] * 7, False), (502, 1, [0.0] * 7, False)]
    rows += [(510, 1, [1.0, 2.0], True), (511, 1, [], True), (512, 2, [], None)]
    rows += [(None, 1, [1.0] * 7, True), (520, None, [1.0] * 7, True), (521, 1, None, True), (522, 1, [1.0, None], True)]
    rows += [(523, 1, [float("nan")] * 7, True), (524, 1, [float("inf")] + [0.0] * 6, True)]
    rows += [(600 + i, i % 2, [1.0] * 7, i == 0) for i in range(30)]  # equal scores
    want = plain.hard_negatives(rows)
    assert want and len({w[0] for w in want}) > 10
    df = vectors(spark, rows)
    assert as_rows(hard_negatives.mine(df, F.col("a"))) == want
    # Many cells, and few rows at once.
    assert as_rows(hard_negatives.mine(df, F.col("a"), cell_bytes=400)) == want
    other = hard_negatives.mine(df, F.col("a"), positives=2, negatives=7, low=-50, high=120)
    assert as_rows(other) == plain.hard_negatives(rows, positives=2, negatives=7, low=-50, high=120)


def test_hard_negatives_of_few_rows(spark):
    assert as_rows(hard_negatives.mine(vectors(spark, []), F.col("a"))) == []
    assert as_rows(hard_negatives.mine(vectors(spark, [(50, 1, [1.0], True)]), F.col("a"))) == []
    assert as_rows(hard_negatives.mine(vectors(spark, [(1, 1, [1.0], False), (2, 1, [1.0], False)]), F.col("a"))) == []
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(vectors(spark, [(1, 1, [1e30], True)]), F.col("a"))


@pytest.mark.parametrize("width,most", [(3, 100), (64, 300), (700, 40_000), (5, 50_000_000), (0, 1)])
def test_residue_products_are_exact(width, most):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-most, most + 1, (n, width)) for n in (9, 13))
    a[0], b[0] = most, -most  # the bound itself
    residues = hard_negatives.Residues(width * most * most)
    assert len(residues.primes) >= 3 and math.prod(residues.primes) > 2 * width * most * most
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(v, w)) for w in b] for v in a], np.int64)
    assert (residues.product(residues.split(a), residues.split(b)) == exact).all()


def test_best_keeps_ties_in_order():
    best, rng = hard_negatives.Best(4, 3), np.random.default_rng(3)
    scores, ids = rng.integers(0, 4, (4, 400)), np.arange(400)
    for at in range(0, 400, 100):
        part = slice(at, at + 100)
        best.add(0, scores[:2, part], scores[:2, part] >= 1, ids[part])
        best.add(2, scores[2:, part], scores[2:, part] >= 9, ids[part])
    for row in range(2):
        found = sorted(zip(-best.score[best.row == row], best.id[best.row == row]))
        assert found == sorted(zip(-scores[row], ids))[:3]
    assert set(best.row) == {0, 1}


# --- Lexical search -----------------------------------------------------------

DOCS = [
    (1, None), (2, ""), (3, " .,!? \n"), (4, "The Cat sat"), (5, "the cat, the CAT; the-cat"), (6, "dog " * 20_000 + "cat"),
    (7, "Straße Ünder 42 cat"), (7, "Straße Ünder 42 cat"), (None, "cat"), (8, "cat"), (9, "cat"), (10, "漢字 かな cat"), (9, "Ünder"),
] + [(100 + i, "filler words here") for i in range(20)]
ASKED = [(1, "cat dog"), (2, None), (3, "..."), (4, "straße ÜNDER"), (1, "cat dog"), (None, "The the CAT"), (5, "nowhere"), (6, "filler")]


def ranked(df):
    return sorted(map(str, ((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())))


def test_lexical_search_equals_plain(spark):
    docs = spark.createDataFrame([(i, t, *FILL) for i, t in DOCS], f"doc_id long, text string, {CLASH}").repartition(5)
    items = spark.createDataFrame([(*a, 1, "t") for a in ASKED], "item_id long, text string, uid int, terms string")
    want = sorted(map(str, plain.lexical_search(DOCS, ASKED)))
    assert ranked(lexical_search.search(docs, items)) == want
    # Several blocks of items; a heap that overflows.
    assert ranked(lexical_search.search(docs, items, max_entries=2)) == want
    assert ranked(lexical_search.search(docs, items, k=3)) == sorted(map(str, plain.lexical_search(DOCS, ASKED, 3)))
    assert ranked(lexical_search.search(docs, items.limit(0))) == []
    assert ranked(lexical_search.search(docs.limit(0), items)) == []


def test_lexical_search_of_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(1, bytearray(b"caf\xff cat"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    items = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert [(r.item_id, r.doc_id) for r in lexical_search.search(docs, items).collect()] == [(1, 1)]


def test_heaps_merge_blocks():
    rng = np.random.default_rng(5)
    scores, ids = rng.integers(0, 5, (300, 3)), rng.permutation(300)
    heaps = lexical_search.Heaps(3, 4)
    for at in range(0, 300, 50):
        heaps.add(scores[at : at + 50], ids[at : at + 50], np.zeros(50, bool))
    for item in range(3):
        found = list(zip(-heaps.score[heaps.item == item], heaps.id[heaps.item == item]))
        assert found == sorted((-s, i) for s, i in zip(scores[:, item], ids) if s > 0)[:4]


# --- Fingerprints -------------------------------------------------------------

def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "dêlta", "漢字", "omega"]) + str(rng.randrange(30)) for _ in range(n))


def decoded(text):
    found = syncmers.Fingerprint.decoded(text)
    return list(zip(found.hashes.tolist(), found.places.tolist()))


@pytest.mark.parametrize("text", [words(60, 1), words(9, 2), "ab" * 200, "x" * 300, "line of text\n" * 40, "😀é" * 90, words(700, 3)])
def test_anchors_are_the_closed_syncmers(text):
    found = syncmers.fingerprints([syncmers.code_points(t.encode()) for t in ("a" * 45 + text[:7], text, "", "tail " * 30)])[1]
    anchors = list(zip(found.hashes.tolist(), found.places.tolist()))
    assert anchors == plain.syncmer_anchors(text)
    assert syncmers.Fingerprint.decoded(found.encoded()).places.tolist() == found.places.tolist()
    gaps = np.diff([0, *found.places, len(text) - syncmers.K])
    assert gaps.max() <= syncmers.SPAN  # no stretch without an anchor


def test_anchors_do_not_hang_on_what_is_around():
    passage, one, two = words(40, 4), words(25, 5), words(33, 6)
    inside = {h for h, _ in plain.syncmer_anchors(passage)}
    for around in (one + passage + two, two + passage, passage):
        found = syncmers.fingerprints([syncmers.code_points(around.encode())])[0]
        assert inside <= set(found.hashes.tolist())


def test_likeness_is_the_longest_common_chain():
    texts = [words(50, 7), words(50, 7)[200:] + words(50, 7)[:200], words(20, 7) + words(20, 8), "", "short", "ab" * 150, "ab" * 90, words(50, 9)]
    found = syncmers.fingerprints([syncmers.code_points(t.encode()) for t in texts])
    lists = [list(zip(f.hashes.tolist(), f.places.tolist())) for f in found]
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert syncmers.likeness(a, b) == pytest.approx(plain.likeness(lists[i], lists[j]))
        assert syncmers.likeness(a, a) == 1


TEXTS = [
    (5, words(80, 10)), (3, words(120, 11)), (9, None), (4, ""), (1, "tiny"), (2, "tiny"), (7, words(200, 12)), (7, words(10, 13)),
    (7, words(200, 12)), (None, words(50, 14)), (None, ""), (11, "é"), (12, "z" * 30_000), (-4, words(2000, 15)), (6, words(80, 10)),
]


@pytest.mark.parametrize("sections", [None, 1, 4, 60])
def test_each_text_against_the_next(spark, sections):
    schema = f"doc_id long, text string, {CLASH}, k string, t string, missing string"
    docs = spark.createDataFrame([(i, t, *FILL, "k", "t", "m") for i, t in TEXTS], schema).repartition(3)
    got = syncmers.compare_with_next(docs, sections=sections).collect()
    tie = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in TEXTS], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i is None, i or 0, tie[t or ""]), i, t or "") for i, t in TEXTS)
    want = []
    for n, (_, i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), edited))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(w[:3] for w in want)
    by_digest = {w[2]: w[3] for w in want}
    prints = {}
    for r in got:
        own, other = decoded(r.fingerprint), decoded(r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(own) < 300:  # the plain chain takes quadratic time
            assert r.near_edited == pytest.approx(plain.likeness(own, other))
        assert prints.setdefault(by_digest[r.edited_sha256], r.edited_fingerprint) == r.edited_fingerprint
        if len(by_digest[r.edited_sha256]) in range(70, 2000):
            assert other == plain.syncmer_anchors(by_digest[r.edited_sha256])
        if r.doc_id == 5:  # followed by its copy
            assert r.near_next == 1 and r.near_edited < 1
        if r.doc_id in (3, -4):
            assert r.near_edited > 0.4 > r.near_next


def test_fingerprints_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one text"), (2, None), (None, "one text"), (2, None)], "doc_id long, text string")
    got = [(r.doc_id, r.n_chars, r.fingerprint) for r in syncmers.fingerprint(docs).collect()]
    assert [g[1] for g in got] == [8, 0, 8, 0] and got[0][2] == got[2][2] != "" and got[1][2] == ""
    assert syncmers.compare_with_next(docs.limit(0)).collect() == [] and syncmers.fingerprint(docs.limit(0)).collect() == []
    alone = syncmers.compare_with_next(docs.limit(1)).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"one one ").hexdigest()
    raw = spark.createDataFrame([(1, bytearray(b"caf\xff"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    assert syncmers.compare_with_next(raw).first().n_chars == 4
    assert base64.b64decode(got[0][2])


def test_fingerprint_query_on_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in syncmers.op13_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for n, (i, text) in enumerate(docs):
        after, half = docs[(n + 1) % len(docs)][1] or "", len(text) // 2
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        if 70 <= len(text) < 1000:
            assert decoded(got[i].fingerprint) == plain.syncmer_anchors(text)
