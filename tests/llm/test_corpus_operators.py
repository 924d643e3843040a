"""Operators over whole corpora: near copies, language model, archives, pipeline."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from docsieve.llm import bpe, jaccard, language_model, warc
from docsieve.session import scratch_path
from tests.llm import plain

WORDS = [f"w{i}" for i in range(400)]


def near_copies(rng, rows, words, group, share):
    base = rng.choices(WORDS, k=words)
    for _ in range(group):
        copy = list(base)
        for _ in range(int(words * share)):
            copy[rng.randrange(words)] = rng.choice(WORDS)
        rows.append((len(rows) + 10, " ".join(copy)))


def corpus():
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, " "), (4, "Two Words"), (5, "two words"), (6, "words two"), (None, "two\twords")]
    for words, group, share in ((60, 30, 0.03), (200, 30, 0.02), (200, 12, 0.0), (30, 20, 0.05), (900, 8, 0.02), (8, 10, 0.1)):
        near_copies(rng, rows, words, group, share)
    passage = " ".join(rng.choices(WORDS, k=60))
    rows += [(len(rows) + 10 + i, passage + " " + " ".join(rng.choices(WORDS, k=40))) for i in range(40)]
    rows += [rows[20], rows[21], (None, rows[30][1])]
    return rows


def answer(got, rows):
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect())
    return found, sorted((str(i), n, str(c)) for (i, _), (n, c) in zip(rows, plain.jaccard(rows)))


def test_components_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, n int").repartition(5)
    found, want = answer(jaccard.jaccard_components(docs), rows)
    assert found == want
    # Regions split around pivots and into blocks.
    found, want = answer(jaccard.jaccard_components(docs, limit=600), rows)
    assert found == want
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {c for _, n, c in want if n}
    assert len(ids) == len(groups) + 3 and {str(i) for i in ids} == groups | {"1", "2", "3"}
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_links_equal_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    want = sorted(
        (str(i), sum(bool(a) and 100 * len(a & b) >= 80 * len(a | b) for k, b in enumerate(sets) if k != j))
        for j, ((i, _), a) in enumerate(zip(rows, sets))
    )
    assert sum(n for _, n in want) > 2 * len(rows)
    for limit in (jaccard.REGION_LIMIT, 600):
        got = jaccard.jaccard_components(docs, limit=limit, links=True)
        assert sorted((str(r.doc_id), r.n_links) for r in got.collect()) == want


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 5, 6, 9, 10, 11, 17, 40, 123, 700):
        for _ in range(60):
            whole = np.unique(rng.integers(0, 2**63, 3 * n + 9, dtype=np.uint64))
            a = np.sort(rng.choice(whole, n, replace=False))
            most = (len(a) + len(a)) // 9 + 2
            gone, new = rng.integers(0, most + 1), rng.integers(0, most + 1)
            b = np.union1d(np.delete(a, rng.choice(n, min(gone, n - 1), replace=False)), rng.integers(0, 2**63, new, dtype=np.uint64))
            common = len(np.intersect1d(a, b))
            if not np.array_equal(a, b) and 100 * common >= 80 * (len(a) + len(b) - common):
                assert np.intersect1d(jaccard.cells(a), jaccard.cells(b)).size, (n, len(b), common)


def test_sketches_keep_linked_sets():
    rng = np.random.default_rng(6)
    for n in (6, 12, 33, 200, 1500):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for gone, new in ((0, n // 5), (n // 6, 0), (n // 10, n // 10), (0, 0)):
            b = np.union1d(a[gone:], rng.integers(0, 2**63, new, dtype=np.uint64))
            far = rng.integers(0, 2**63, n, dtype=np.uint64)
            sets = [a, b, far]
            kept = jaccard.near_members(np.array([1, 2, 3]), np.array([len(s) for s in sets]), [jaccard.sketch(s) for s in sets])
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                assert kept[0] and kept[1]
            assert n < 100 or not kept[2]


def test_cells_hold_for_sets_with_empty_buckets():
    """The prefix cells: sets that leave more buckets empty than are spare."""
    rng = np.random.default_rng(5)
    special = 0
    for _ in range(3000):
        a = np.unique(rng.integers(0, 2**63, 45, dtype=np.uint64))
        b = np.union1d(a[4:], rng.integers(0, 2**63, 5, dtype=np.uint64))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            special += len(jaccard.cells(a)) > 24
            assert np.intersect1d(jaccard.cells(a), jaccard.cells(b)).size
    assert special


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (5, 200)], "a long, b long")
    found = {r.key: r.part for r in jaccard.components(links).collect()}
    assert found == {i: 0 for i in range(61)} | {200: 0, 100: 100, 101: 100, 103: 100}


def test_model_equals_plain_counts(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["A", "b", "c", "d", "É", "f"] + WORDS[:40], k=rng.randint(0, 30))) for _ in range(80)] + [None, "", " "]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int").repartition(3)
    model = language_model.train(docs.where("doc_id < 60"), shards=3)
    tokens = [plain.SPACED.findall((t or "").translate(plain.LOWER)) + [None] for t in texts]
    counts, pairs = Counter(), Counter()
    for t in tokens[:60]:
        counts.update(t)
        pairs.update(zip([0, *t], t))
    of_counts = Counter(pairs.values())
    d = (0, *language_model.discounts(*(of_counts[k] for k in (1, 2, 3, 4))))
    before = Counter(w for _, w in pairs)
    of_before = Counter(before.values())
    e = (0, *language_model.discounts(*(of_before[k] for k in (1, 2, 3, 4))))
    rest = sum(e[min(n, 3)] for n in before.values()) / len(pairs)
    total, left = Counter(), Counter()
    for (h, _), n in pairs.items():
        total[h] += n
        left[h] += d[min(n, 3)]

    def p(h, w):
        low = (before[w] - e[min(before[w], 3)]) / len(pairs) + rest / (len(counts) + 1)
        return low if h not in total else (pairs[h, w] - d[min(pairs[h, w], 3)]) / total[h] + left[h] / total[h] * low

    for h in (0, "b", "w3"):
        assert abs(sum(p(h, w) for w in counts) + p(h, "unseen") - 1) < 1e-9
    n = sum(counts.values())
    for r in language_model.score_texts(docs, model).collect():
        t = tokens[r.doc_id]
        assert r.n_tokens == len(t) and r.n_known == sum(w in counts for w in t)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in t), abs_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(h, w)) for h, w in zip([0, *t], t)), abs_tol=1e-9)
    nothing = language_model.train(docs.limit(0), shards=2)
    assert {r.score for r in language_model.score_texts(docs, nothing).collect()} == {0.0} == {
        r.base_score for r in language_model.score_texts(docs, nothing).collect()
    }
    assert language_model.score_texts(docs.limit(0), model).count() == 0


def test_archives_hold_every_page_once(spark, tmp_path):
    html = [(3, "<p>é</p>"), (1, "<p>é</p>"), (2, None), (5, ""), (4, "long " * 300_000), (6, "a\r\n\r\nWARC/1.1\r\n"), (6, "a\r\n\r\nWARC/1.1\r\n"), (None, "<p>é</p>"), (None, "alone")]
    pages = spark.createDataFrame([(i, "http://x/\r\ny" if i else None, h, "x") for i, h in html], "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "warc-test")
    index = warc.archive_pages(pages.repartition(2), folder)
    got = sorted((str(warc_id(r.record_id)), r.record_type, r.payload_bytes, r.payload_digest, str(warc_id(r.refers_to))) for r in warc.read_records(index, f"{folder}/members").collect())
    first = {}
    for i, h in html:
        first[h or ""] = min((x for x in (first.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, h in html:
        again = first[h or ""] is not None and (i is None or i > first[h or ""])
        raw = (h or "").encode()
        want.append((str(i), "revisit" if again else "response", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), str(first[h or ""] if again else None)))
    assert got == sorted(want)
    for r in index.collect():  # any member inflates alone
        with warc.open_file(f"{folder}/members", r.archive) as f:
            f.seek(r.offset)
            assert zlib.decompress(f.read(r.length), 31).startswith(b"WARC/1.1\r\n")
    large = {r.refers_to for r in warc.mark_revisits(pages, min_bytes=1).where("octet_length(payload) = 0").collect()}
    assert large == {None}
    assert warc.archive_pages(pages.limit(0), scratch_path(spark, "warc-none")).count() == 0


def warc_id(record_id):
    found = record_id and record_id.removeprefix("<urn:x-page:").removesuffix(">")
    return int(found) if found else None


def test_inflate_reads_streams_and_members():
    data = [random.Random(i).randbytes(3 << 20) + bytes(9 << 20) for i in range(2)]
    members = b"".join(zlib.compress(d, 1, 31) for d in data)
    assert b"".join(warc.inflate(members)) == b"".join(data)


def test_pipeline_equals_plain_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality rules":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            base = {i for i, t in rows.items() if (q := plain.quality(t))[0] >= 50 and 100 * q[4] <= 50 * q[0]}
            assert set(kept) <= base and {i for i in base if labels.get(i) == 1} <= set(kept)
        elif name == "n-gram Jaccard join":
            before = sorted(rows.items())
            assert set(kept) == {c for n, c in plain.jaccard(before) if n}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            hits = {i: plain.windows_hit(t, items) for i, t in rows.items()}
            assert set(kept) == {i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
        else:
            assert set(kept) == set(rows) and all(not plain.base_spans(t) for t in kept.values())
            assert all(kept[i] == t for i, t in rows.items() if not plain.base_spans(t))
        rows = kept
    enc = bpe.encoding(bpe.default_ranks())
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in rows.items()}
    assert {(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()} == set(got.items())
