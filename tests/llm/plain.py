"""Plain Python versions of the contracts, for comparison."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def jaccard(rows):
    """[(n_shingles, component_id)] of [(doc_id, text)], by comparing all pairs of rows."""
    sets = []
    for _, text in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    group = list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {g: min((x for x in found if x is not None), default=None) for g, found in ids.items()}
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def windows_hit(text, items, window=13):
    """(n_words, n_hit, item ids) of a text against [(item_id, text)]."""
    words, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    for item, other in items:
        w = ALNUM.findall((other or "").translate(LOWER))
        k = min(len(w), window)
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def base_spans(text):
    text = text or ""
    keyword = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    assign = re.compile(keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    often = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if SPACED.search(x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def greedy_tokens(word, vocabulary):
    """Longest-match pieces of a byte string; None if a rest fits nothing."""
    count = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), None)
        if size is None:
            return None
        word, count = word[size:], count + 1
    return count


def hard_negatives(rows, scale=256, positives=5, negatives=3, low=50, high=95):
    """Rows of (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of
    [(vec_id, label, vector, is_anchor)], by all inner products."""
    part = [
        (i, label, [math.floor(scale * x) for x in v], a)
        for i, label, v, a in rows
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (anchor, label, v, asked) in enumerate(part):
        if not asked:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == label, m) for m, (i, other, w, _) in enumerate(part)]
        scored.sort()
        near = [(i, -s) for s, i, same, m in scored if same and m != n][:positives]
        for positive, p in near:
            found = [(i, -s) for s, i, same, _ in scored if not same and low * p <= -100 * s <= high * p][:negatives]
            out += [(anchor, positive, r + 1, i, p, s) for r, (i, s) in enumerate(found)]
    return sorted(out)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lexical_search(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    counted = [(i, Counter(t.translate(LOWER) for t in TERM.findall(text or ""))) for i, text in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = {t.translate(LOWER) for t in TERM.findall(text or "")}, []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in asked if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def syncmer_anchors(text, k=40, s=9):
    """[(hash, place)] of the closed syncmers of a text, one substring at a time."""

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    def hashed(part):
        total = 0
        for c in part:
            total = (total * 0x9E3779B97F4A7C15 + mixed((ord(c) + 0x9E3779B97F4A7C15) % 2**64)) % 2**64
        return mixed(total)

    inner = [hashed(text[i : i + s]) for i in range(len(text) - s + 1)]
    out = []
    for i in range(len(text) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append((hashed(text[i : i + k]) >> 32, i))
    return out


def likeness(a, b):
    """Of two anchor lists: twice the longest common chain of n-th occurrences, over all anchors."""

    def named(anchors):
        seen, out = Counter(), []
        for h, _ in anchors:
            out.append((h, seen[h]))
            seen[h] += 1
        return out

    a, b = named(a), named(b)
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)  # longest common subsequence; no name occurs twice in a list
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return 2 * row[-1] / (len(a) + len(b))
