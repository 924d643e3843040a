"""A lexicon of phrases, masked whole in one pass over the tokens.

The lexicon is cut into blocks of bounded size, each sent to the workers once; a token
leads to the phrases that begin with it.  Every block marks its matches in the row, and the
row keeps the leftmost, the longest of those, and goes on behind it.  No token list is
shuffled, and the lexicon may be of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions.arrays import sliced
from ..functions.text import MASK, tokenize
from ..session import materialise

#: Tokens of the phrases in a block.
BLOCK_TOKENS = 500_000

Starts = dict[str, dict[int, set[tuple[str, ...]]]]


def starts_of(phrases: Sequence[Sequence[str]]) -> Starts:
    """By first token and length, the phrases."""
    out: Starts = {}
    for phrase in phrases:
        if phrase:
            out.setdefault(phrase[0], {}).setdefault(len(phrase), set()).add(tuple(phrase))
    return out


def longest_at(tokens: list[str], starts: Starts) -> list[int]:
    """For every place the length of the longest phrase that begins there, 0 for none."""
    out = [0] * len(tokens)
    for i, token in enumerate(tokens):
        if by_length := starts.get(token):
            for n in sorted(by_length, reverse=True):
                if i + n <= len(tokens) and tuple(tokens[i : i + n]) in by_length[n]:
                    out[i] = n
                    break
    return out


def masked(tokens: list[str], spans: Sequence[Sequence[int]], mask: str) -> list[str]:
    """``tokens`` with each leftmost-longest match replaced by one ``mask``."""
    out, i = [], 0
    while i < len(tokens):
        n = max(s[i] for s in spans)
        out.append(mask if n else tokens[i])
        i += max(n, 1)
    return out


def _blocks(lexicon: DataFrame, size: int, mode: str) -> list[list[list[str]]]:
    """The lexicon's phrases as lower-case token lists, in blocks of about ``size`` tokens."""
    words = lexicon.select(F.transform(tokenize(F.lower("phrase"), mode), F.lower).alias("t")).where(F.size("t") > 0).distinct()
    words = materialise(words, "phrases")
    n = max(1, -(-(words.agg(F.sum(F.size("t"))).first()[0] or 0) // size))
    part = F.pmod(F.xxhash64("t"), F.lit(n))
    return [[r["t"] for r in words.where(part == b).collect()] for b in range(n)]


def mask_phrases(
    docs: DataFrame, lexicon: DataFrame, tokens: str | Sequence[str] = "tokens", mask: str = MASK,
    mode: str = "words", block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``docs`` with the phrases of a table (column ``phrase``) masked in one or several token lists.

    Letter case does not count, and a phrase is cut into tokens as ``mode`` cuts texts.  A
    phrase of one token masks that token.  Matches never overlap: the leftmost goes first,
    the longest of those at one place.  NULL phrases mask nothing; NULL lists stay NULL and
    NULL tokens match nothing.
    """
    spark = docs.sparkSession
    indexes = [spark.sparkContext.broadcast(starts_of(b)) for b in _blocks(lexicon, block_tokens, mode)]

    def finder(index) -> Column:
        @F.arrow_udf(ArrayType(IntegerType()))
        def spans(lists: pa.Array) -> pa.Array:
            known = index.value
            kind = pa.list_(pa.int32())
            out = [
                pa.array([None if x is None else longest_at([t.lower() if t else "" for t in x], known) for x in part.to_pylist()], kind)
                for (part,) in sliced(lists)
            ]
            return pa.concat_arrays(out) if out else pa.array([], kind)

        return spans

    @F.arrow_udf(ArrayType(StringType()))
    def replace(lists: pa.Array, *spans: pa.Array) -> pa.Array:
        kind, out = pa.list_(pa.string()), []
        for part in sliced(lists, *spans):
            rows = zip(*(column.to_pylist() for column in part), strict=True)
            out.append(pa.array([None if x is None else masked(x, s, mask) for x, *s in rows], kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    names = [tokens] if isinstance(tokens, str) else list(tokens)
    return docs.withColumns({c: replace(F.col(c), *[finder(index)(F.col(c)) for index in indexes]) for c in names})
