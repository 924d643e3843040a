"""Porter stemming of token columns.

The published suffix-stripping algorithm (M. F. Porter, 1980) with the usual
later extensions (irregular words, words of two letters kept, ``-ied``,
``-fulli``, ``-logi``).  Spark ships token arrays to the workers in Arrow
batches; only the distinct tokens of a batch are stemmed.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the published algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
_STEP2_ENDS, _STEP3_ENDS = (tuple(old for old, _ in step) for step in (STEP2, STEP3))
# Ends that some step looks for, before or after "y" has become "i": a word with none of them stays.
_ENDS = tuple({*"sye", "ed", "ing", "ll", *_STEP2_ENDS, *_STEP3_ENDS, *STEP4})


def _shape(word: str) -> str:
    """One ``c`` or ``v`` per letter; ``y`` is a vowel after a consonant."""
    marks: list[str] = []
    for ch in word:
        if ch in "aeiou":
            marks.append("v")
        elif ch == "y" and marks and marks[-1] == "c":
            marks.append("v")
        else:
            marks.append("c")
    return "".join(marks)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape[-3:] == "cvc" and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
    if not cut or "v" not in _shape(w[:-cut]):
        return w
    w = w[:-cut]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c":
        return w if w[-1] in "lsz" else w[:-1]
    return w + "e" if _measure(w) == 1 and _short_end(w) else w


def _final_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c" else w


def _double_suffix(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _double_suffix(w[:-2])
    if not w.endswith(_STEP2_ENDS):
        return w
    for old, new in STEP2:
        if w.endswith(old):
            # "logi" is judged with its "l" counted to the stem.
            base = w[: -len(old)]
            probe = base + "l" if old == "logi" else base
            return base + new if _measure(probe) > 0 else w
    return w


def _third(w: str) -> str:
    if not w.endswith(_STEP3_ENDS):
        return w
    for old, new in STEP3:
        if w.endswith(old):
            base = w[: -len(old)]
            return base + new if _measure(base) > 0 else w
    return w


def _fourth(w: str) -> str:
    if not w.endswith(STEP4):
        return w
    for old in STEP4:
        if w.endswith(old):
            base = w[: -len(old)]
            allowed = old != "ion" or base[-1:] in ("s", "t")
            return base if allowed and _measure(base) > 1 else w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        base = w[:-1]
        m = _measure(base)
        if m > 1 or (m == 1 and not _short_end(base)):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stem(word: str) -> str:
    """Stem of one word, lower-cased first."""
    w = word.lower()
    return _stem(w) if w.endswith(_ENDS) else w


@lru_cache(maxsize=1 << 18)
def _stem(w: str) -> str:
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) < 3:
        return w
    for step in (_plural, _past, _final_y, _double_suffix, _third, _fourth, _tidy):
        w = step(w)
    return w


def _stem_distinct(values: pa.Array) -> pa.Array:
    coded = values.dictionary_encode()
    stems = [None if w is None else stem(w) for w in coded.dictionary.to_pylist()]
    return pa.array(stems, type=pa.string()).take(coded.indices)


@F.arrow_udf(ArrayType(StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Stem every token of an array column, order kept; NULL lists stay NULL."""
    sizes = tokens.value_lengths().fill_null(0)
    ends = sizes.cast(pa.int64()).to_numpy(zero_copy_only=False).cumsum()
    offsets = pa.array([0, *ends.tolist()], type=pa.int32())
    out = pa.ListArray.from_arrays(offsets, _stem_distinct(tokens.flatten()))
    if tokens.null_count:
        return pc.if_else(tokens.is_null(), pa.scalar(None, out.type), out)
    return out


@F.arrow_udf(StringType())
def stem_word(word: pa.Array) -> pa.Array:
    """Stem a plain string column, for vocabulary tables."""
    return _stem_distinct(word)
