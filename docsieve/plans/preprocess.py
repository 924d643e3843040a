"""Field-driven preprocessing: from text and metadata columns to token bags."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.token_rules import replace_tokens
from ..operators.expand import records
from ..operators.rows import mask_tokens

# Field sets of the stored feature runs, (fields, n-gram size).
OPTIMAL = ("title", "abstract", "mesh_terms", "publication_types")
FIELD_RUNS = {
    "title": (("title",), 1),
    "abstract": (("title", "abstract"), 1),
    "authors": (("title", "abstract", "author"), 1),
    "affiliations": (("title", "abstract", "affiliation"), 1),
    "chemical": (("title", "abstract", "chemical_list"), 1),
    "keywords": (("title", "abstract", "keywords"), 1),
    "journal": (("title", "abstract", "medline_ta"), 1),
    "mesh": (("title", "abstract", "mesh_terms"), 1),
    "pub_type": (("title", "abstract", "publication_types"), 1),
    "all": (
        ("title", "abstract", "author", "affiliation", "chemical_list", "keywords",
         "medline_ta", "mesh_terms", "publication_types"),
        1,
    ),
    "optimal": (OPTIMAL, 1),
}
NGRAM_RUNS = {"unigrams": (OPTIMAL, 1), "bigrams": (OPTIMAL, 2), "trigrams": (OPTIMAL, 3)}
TEST_RUNS = {"unigrams": (OPTIMAL, 1)}
# Pooling runs of the vector features: whether max and min are added.
POOLING_RUNS = {"biobert_all": True, "biobert_avg": False}

Runs = Mapping[str, tuple[Sequence[str], int]]


def text_tokens(
    col: str,
    mode: str = "full",
    stop_words: Sequence[str] = (),
    lexicon: Sequence[str] = (),
    stem: bool = False,
) -> Column:
    """Cleaned tokens of a text column: tokenise, drop stop words, mask, lower-case, clean
    numbers and, with ``stem``, stem."""
    return replace_tokens(T.tokenize(col, mode), stop_words, lexicon, stems=stem)


def field_tokens(
    df: DataFrame,
    fields: Sequence[str],
    stop_words: Sequence[str] = (),
    lexicon: Sequence[str] | DataFrame = (),
    mode: str = "full",
    stem: bool = True,
    key: str = "pmid",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, keep, one token list per field), suffixed but without n-grams.

    Title and abstract take the text path, every other field the list path.  All
    of it stays inside the row; what becomes of a token is one Arrow step per text
    field over its distinct tokens.  A short ``lexicon`` is a list; a large one is a table (column ``token``) and joined.
    """
    for f in fields:
        T.field_suffix(f)
    texts = [f for f in fields if f in T.TEXT_FIELDS]
    if isinstance(lexicon, DataFrame):
        words = {f: replace_tokens(T.tokenize(f, mode), stop_words, (), clean=False) for f in texts}
        lists = df.select(key, *keep, *[words.get(f, F.col(f)).alias(f) for f in fields])
        masked = mask_tokens(lists, lexicon, tokens=texts, key=key) if texts else lists
        done = {f: replace_tokens(f, stems=stem) for f in texts}
        cleaned = masked.select(key, *keep, *[done.get(f, F.col(f)).alias(f) for f in fields])
    else:
        done = {f: text_tokens(f, mode, stop_words, lexicon, stem) for f in texts}
        cleaned = df.select(key, *keep, *[done.get(f, F.col(f)).alias(f) for f in fields])

    def finish(f: str) -> Column:
        if f in T.TEXT_FIELDS:
            return T.suffix(f, f)
        if f in T.SCALAR_FIELDS:
            return F.array(T.scalar_field(f, f))
        return T.list_field(f, f)

    return cleaned.select(key, *keep, *[finish(f).alias(f) for f in fields])


def bag(
    fields: Sequence[str], ngram: int = 1, keep_empty: bool = False, grams: Mapping[tuple[str, int], str] | None = None
) -> Column:
    """One token list of several field lists; n-grams never cross a field.

    ``keep_empty`` gives an empty field its empty token, as a joined string
    would; by default empty tokens are dropped.  ``grams`` are columns that hold n-grams already.
    """
    known = grams or {}

    def part(f: str) -> Column:
        if f not in T.TEXT_FIELDS:  # text tokens are never empty
            return F.col(f) if keep_empty else F.filter(f, lambda t: t != "")
        tokens = T.ngrams(f, ngram, [known[f, k] for k in range(2, ngram + 1)] if (f, ngram) in known else None)
        return F.when(F.size(f) == 0, F.array(F.lit(""))).otherwise(tokens) if keep_empty else tokens

    return F.concat(*[part(f) for f in fields])


def combine_fields(
    df: DataFrame,
    fields: Sequence[str],
    ngram: int = 1,
    keep_empty: bool = False,
    key: str = "pmid",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, keep, tokens) from a table of field token lists."""
    return df.select(key, *keep, bag(fields, ngram, keep_empty).alias("tokens"))


def bag_and_text(
    df: DataFrame, bag_fields: Sequence[str], text_fields: Sequence[str], key: str = "pmid"
) -> DataFrame:
    """(key, tokens, text fields): list fields in one bag, texts kept by name."""
    return df.select(key, bag(bag_fields).alias("tokens"), *text_fields)


def preprocess(
    df: DataFrame,
    fields: Sequence[str],
    ngram: int = 1,
    stop_words: Sequence[str] = (),
    lexicon: Sequence[str] | DataFrame = (),
    mode: str = "full",
    stem: bool = True,
    keep_empty: bool = False,
    key: str = "pmid",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, keep, tokens): the token bag of a field list."""
    lists = field_tokens(df, fields, stop_words, lexicon, mode, stem, key, keep)
    return combine_fields(lists, fields, ngram, keep_empty, key, keep)


def run_matrix(
    lists: DataFrame,
    runs: Runs,
    keep_empty: bool = False,
    key: str = "pmid",
    made: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """(run, key, tokens): every run's bag from lists tokenised once.  ``made`` are columns in place
    of the tokens, worked out of them before a row is copied for its runs.

    The run list is configuration, so the fan-out is a generator inside the row.  Runs share
    the n-grams of a field, and longer ones go on from shorter.
    """
    grams: dict[tuple[str, int], str] = {}
    for f in filter(T.TEXT_FIELDS.__contains__, run_fields(runs)):
        for n in range(2, max((n for fields, n in runs.values() if f in fields), default=1) + 1):
            shorter = grams.get((f, n - 1))
            grams[f, n] = f"_{f}_{n}"
            lists = lists.withColumn(grams[f, n], T.longer_grams(shorter, f, n) if shorter else T.grams(f, n))
    bags = F.array(
        *[
            F.struct(F.lit(name).alias("run"), bag(fields, n, keep_empty, grams).alias("tokens"))
            for name, (fields, n) in runs.items()
        ]
    )
    if made:
        bags = F.transform(bags, lambda b: F.struct(b["run"].alias("run"), *[make(b["tokens"]).alias(c) for c, make in made.items()]))
    return records(lists, [key], bags, "run").select("run", key, *(made or ["tokens"]))


def run_fields(runs: Runs) -> list[str]:
    """Fields used by any run, in first-use order."""
    return list(dict.fromkeys(f for fields, _ in runs.values() for f in fields))
