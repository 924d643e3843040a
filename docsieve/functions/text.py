"""Text and token-list expressions.  Everything here is Column in, Column out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: they decide the stored token strings -------------------
SEPARATOR = " ;; "
MASK = "DRUGNAME"
NUMBER = "##"
PLACEHOLDER = "xxxxx"
FIELD_SUFFIX = {
    "abstract": "",
    "title": "T",
    "affiliation": "AF",
    "author": "AUTH",
    "chemical_list": "CH",
    "medline_ta": "J",
    "keywords": "KW",
    "mesh_terms": "MSH",
    "publication_types": "TY",
}
TEXT_FIELDS = ("title", "abstract")
SCALAR_FIELDS = ("medline_ta",)
_END = "\ufdd0"  # no character; marks the end of a sentence while pieces are joined
WORD_PATTERN = r"[\p{L}\d]+"
# Punctuation at either edge of a blank-separated piece; a line's end (U+0085) may follow it.
PIECE_EDGES = r"(?<![^\s\p{Z}])\p{P}+|\p{P}+(?=\x{85}?(?:[\s\p{Z}]|\z))"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKS = " \t\n\r\f\u000b"
# Function words the built-in English list of Spark lacks.
EXTRA_STOP_WORDS = (
    "due", "also", "among", "however", "may", "might", "must", "per", "since",
    "therefore", "thus", "upon", "using", "via", "well", "whether", "within",
    "without", "yet", "across", "along", "although", "around", "become",
    "could", "else", "ever", "hence", "every", "even", "many", "much", "would",
)
# --------------------------------------------------------------------------


def field_suffix(field: str) -> str:
    """Suffix marking the tokens of ``field``; unknown names are refused."""
    if field not in FIELD_SUFFIX:
        raise ValueError(f"unknown field {field!r}; known: {sorted(FIELD_SUFFIX)}")
    return FIELD_SUFFIX[field]


def default_stop_words(spark: SparkSession) -> list[str]:
    """Spark's English stop words plus :data:`EXTRA_STOP_WORDS`."""
    from pyspark.ml.feature import StopWordsRemover

    builtin = StopWordsRemover.loadDefaultStopWords("english")
    return sorted({*builtin, *EXTRA_STOP_WORDS})


def filled(col: Column | str) -> Column:
    """NULL text counts as empty text."""
    return F.coalesce(_col(col), F.lit(""))


def tokenize(col: Column | str, mode: str = "words") -> Column:
    """Tokens of a text column.

    ``words``: lower-cased letter/digit runs.  ``full``: blank-separated pieces
    with punctuation trimmed at both ends, case kept (numbers such as ``3.25l/h``
    stay whole for :func:`clean_numbers`).
    """
    if mode == "words":
        return F.regexp_extract_all(F.lower(filled(col)), F.lit(WORD_PATTERN), F.lit(0))
    if mode == "full":
        # Trimmed in the whole text, so that no expression runs once per piece.
        trimmed = F.regexp_replace(filled(col), PIECE_EDGES, "")
        return F.filter(F.split(trimmed, r"[\s\p{Z}]+"), lambda t: t != "")
    raise ValueError(f"mode must be 'words' or 'full', not {mode!r}")


def drop_stopwords(tokens: Column | str, words: Sequence[str]) -> Column:
    """Remove stop words, whatever their case.  ``words`` is a literal set."""
    wanted = sorted({w.lower() for w in words})
    if not wanted:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(wanted))


def mask_words(tokens: Column | str, words: Sequence[str], mask: str = MASK) -> Column:
    """Replace the words of a short literal lexicon (see ``mask_tokens`` for a
    lexicon table) and lower-case every other token."""
    wanted = sorted({w.lower() for w in words})
    if not wanted:
        return F.transform(_col(tokens), F.lower)
    return F.transform(
        _col(tokens),
        lambda t: F.when(F.lower(t).isin(wanted), F.lit(mask)).otherwise(F.lower(t)),
    )


def clean_numbers(tokens: Column | str) -> Column:
    """Number clean-up inside tokens.

    A token without digit stays.  Otherwise ASCII punctuation goes; all digits
    become ``##``; a leading digit splits the token into letter and digit runs
    (digit runs become ``##``); anything else stays as stripped.
    """

    def runs(t: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(t, F.lit(r"\p{L}+|\d+"), F.lit(0)),
            lambda x: F.when(x.rlike(r"^\d"), F.lit(NUMBER)).otherwise(x),
        )

    def one(t: Column) -> Column:
        whole = F.translate(t, "\n", "")
        stripped = F.translate(t, "\n" + ASCII_PUNCTUATION, "")
        return (
            F.when(~t.rlike(r"[\d\n]"), F.array(t))  # most tokens stop here
            .when(~t.rlike(r"\d"), F.array(whole))
            .when(stripped.rlike(r"^\d"), runs(stripped))
            .otherwise(F.array(stripped))
        )

    return F.flatten(F.transform(_col(tokens), one))


def suffix(tokens: Column | str, field: str) -> Column:
    """Mark each token with the suffix of its field."""
    mark = field_suffix(field)
    return F.transform(_col(tokens), lambda t: F.concat(t, F.lit(mark))) if mark else _col(tokens)


def grams(tokens: Column | str, n: int) -> Column:
    """The n-grams only (n = 2 or 3), empty for shorter lists."""
    t = _col(tokens)
    size = F.size(t)

    def pair(left: Column, right: Column) -> Column:
        return F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))

    def window(start: int) -> Column:
        return F.slice(t, F.lit(start), F.greatest(size - (n - 1), F.lit(0)))

    out = window(1)
    for start in range(2, n + 1):
        out = pair(out, window(start))
    return out


def longer_grams(shorter: Column | str, tokens: Column | str, n: int) -> Column:
    """The n-grams of a list from its (n - 1)-grams."""
    g, t = _col(shorter), _col(tokens)
    count = F.greatest(F.size(t) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(g, F.lit(1), count), F.slice(t, F.lit(n), count), lambda a, b: F.concat_ws(" ", a, b))


def ngrams(tokens: Column | str, n: int, known: Sequence[Column | str] | None = None) -> Column:
    """Unigrams, then bigrams (n >= 2), then trigrams (n = 3).

    A list shorter than ``n`` keeps its unigrams only: with n = 3 and two
    tokens not even the bigram is added.  ``known`` are its bigrams, trigrams, ... if there are columns of them.
    """
    t = _col(tokens)
    if n == 1:
        return t
    if n not in (2, 3):
        raise ValueError("n must be 1, 2 or 3")
    parts = [t] + ([_col(k) for k in known] if known else [grams(t, k) for k in range(2, n + 1)])
    return F.when(F.size(t) >= n, F.concat(*parts)).otherwise(t)


def join_tokens(tokens: Column | str) -> Column:
    """Token list to its stored string form."""
    return F.array_join(_col(tokens), SEPARATOR)


def split_tokens(col: Column | str) -> Column:
    """Stored string form back to a token list (empty text gives ``['']``)."""
    return F.split(_col(col), SEPARATOR)


def list_field(col: Column | str, field: str) -> Column:
    """``;``-separated metadata to suffixed items; an empty item stays empty."""
    mark = field_suffix(field)
    return F.transform(
        F.split(filled(col), ";"),
        lambda x: F.when(x == "", x).otherwise(F.concat(F.btrim(x, F.lit(BLANKS)), F.lit(mark))),
    )


def scalar_field(col: Column | str, field: str) -> Column:
    """Single-valued metadata: the value and its suffix, suffix alone if empty."""
    return F.concat(filled(col), F.lit(field_suffix(field)))


def sentences(col: Column | str, abbreviations: Sequence[str] = ()) -> Column:
    """Sentence strings: cut after ``.``, ``!`` or ``?`` followed by a blank, but not after the
    full stop of one of the ``abbreviations`` (lower case, without it; see
    :mod:`..operators.abbreviations`)."""
    pieces = F.regexp_extract_all(
        filled(col), F.lit(r"(?s).+?(?:[.!?]+(?:[ \t\n\f\r]+|\z)|\z)"), F.lit(0)
    )
    known = sorted({a.lower() for a in abbreviations})
    if known:
        # Pieces that end in an abbreviation run on; a mark ends the others.
        last = lambda p: F.regexp_extract(p, r"([^\s\p{Z}]+)\.[\s\p{Z}]*\z", 1)
        core = lambda p: F.lower(F.regexp_replace(last(p), r"^[^\p{L}\d]+", ""))
        marked = F.transform(pieces, lambda p: F.when(core(p).isin(known), p).otherwise(F.concat(p, F.lit(_END))))
        pieces = F.split(F.array_join(marked, ""), _END)
    trimmed = F.transform(pieces, lambda s: F.btrim(s, F.lit(" \t\n\f\r")))
    return F.filter(trimmed, lambda s: s != "")


def placeholder_if_empty(col: Column | str, value: str = PLACEHOLDER) -> Column:
    """Empty text (NULL included) becomes a placeholder."""
    c = filled(col)
    return F.when(F.length(c) == 0, F.lit(value)).otherwise(c)


def term_runs(tokens: Column | str) -> Column:
    """Distinct tokens of one list with their counts, as array<struct<token,n>>.

    Sorting the list and reading run lengths keeps the count inside the row:
    no explode, no shuffle.
    """
    # Materialise the sorted list once: nested lambdas see it as one variable.
    wrapped = F.array(F.sort_array(_col(tokens)))

    def runs(s: Column) -> Column:
        size = F.size(s)
        ends = F.filter(
            F.sequence(F.lit(1), size),
            lambda i: (i == size) | (F.get(s, i - 1) != F.get(s, i)),
        )
        return F.element_at(
            F.transform(
                F.array(ends),
                lambda e: F.transform(
                    e,
                    lambda x, i: F.struct(
                        F.get(s, x - 1).alias("token"),
                        (x - F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)))
                        .cast("bigint")
                        .alias("n"),
                    ),
                ),
            ),
            1,
        )

    return F.flatten(F.transform(F.filter(wrapped, lambda s: F.size(s) > 0), runs))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
