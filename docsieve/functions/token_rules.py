"""What happens to a token hangs on the token alone, so it is worked out once per distinct token.

A rule maps a token to the tokens that replace it: none for a stop word, several where
numbers are cut apart.  Lists of tokens go through it in one Arrow step; within a batch
every distinct token is looked at once, and what a worker has learned it keeps, up to a
bound, for the batches and tasks that follow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .arrays import sliced
from .stemming import stem
from .text import ASCII_PUNCTUATION, MASK, NUMBER

#: Tokens whose outcome a worker remembers for each rule.
REMEMBERED = 1 << 18
_DIGIT = regex.compile("[0-9]")
_RUNS = regex.compile(r"\p{L}+|[0-9]+")
_STRIPPED = str.maketrans("", "", "\n" + ASCII_PUNCTUATION)
_LEARNED: dict[tuple, dict[str, tuple[str, ...]]] = {}

Rule = Callable[[str], tuple[str, ...]]


def cleaned(token: str) -> tuple[str, ...]:
    """Number clean-up of one token, as ``text.clean_numbers`` does it."""
    if token.isalpha():  # most tokens: neither a digit nor a line's end
        return (token,)
    if not _DIGIT.search(token):
        return (token.replace("\n", ""),)
    bare = token.translate(_STRIPPED)
    if not "0" <= bare[:1] <= "9":
        return (bare,)
    return tuple(NUMBER if "0" <= run[0] <= "9" else run for run in _RUNS.findall(bare))


def rule(stop_words: Sequence[str] = (), lexicon: Sequence[str] | None = None, clean: bool = True, stems: bool = False) -> tuple[tuple, Rule]:
    """(name, rule) that drops stop words, masks a lexicon, lower-cases, cleans numbers and stems.

    ``lexicon`` None leaves masks and case alone; an empty one only lower-cases.
    """
    stop = frozenset(w.lower() for w in stop_words)
    names = None if lexicon is None else frozenset(w.lower() for w in lexicon)

    def replaced(token: str) -> tuple[str, ...]:
        small = token.lower()
        if small in stop:
            return ()
        if names is not None:
            token = MASK if small in names else small
        parts = cleaned(token) if clean else (token,)
        return tuple(map(stem, parts)) if stems else parts

    return (stop, names, clean, stems), replaced


def _replace(tokens: pa.Array, name: tuple, replaced: Rule) -> pa.Array:
    """Lists of tokens with every token replaced; NULL lists and tokens stay NULL."""
    known = _LEARNED.setdefault(name, {})
    coded = tokens.flatten().dictionary_encode()
    if coded.null_count:  # a NULL token is an entry of its own
        coded = tokens.flatten().dictionary_encode(null_encoding="encode")
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    parts = list(map(known.get, words))
    for i, w in enumerate(words):
        if parts[i] is None:
            if w is None:
                parts[i] = (None,)
                continue
            if len(known) >= REMEMBERED:
                known.clear()
            parts[i] = known[w] = replaced(w)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = pa.array(list(chain.from_iterable(parts)), pa.string())
    index = coded.indices.to_numpy(zero_copy_only=False)
    each = sizes[index] if len(index) else np.empty(0, np.int64)
    starts = (np.cumsum(sizes) - sizes)[index] if len(index) else each
    ends = np.cumsum(each)
    take = np.repeat(starts, each) + np.arange(each.sum()) - np.repeat(ends - each, each)
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]]
    out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.take(pa.array(take)))
    return pc.if_else(tokens.is_null(), pa.scalar(None, out.type), out) if tokens.null_count else out


def replace_tokens(
    tokens: Column | str,
    stop_words: Sequence[str] = (),
    lexicon: Sequence[str] | None = None,
    clean: bool = True,
    stems: bool = False,
) -> Column:
    """A token list with every token put through the :func:`rule` of these settings."""
    name, replaced = rule(stop_words, lexicon, clean, stems)

    @F.arrow_udf(ArrayType(StringType()))
    def step(lists: pa.Array) -> pa.Array:
        out = [_replace(part, name, replaced) for (part,) in sliced(lists)]
        return pa.concat_arrays(out) if out else _replace(lists, name, replaced)

    return step(F.col(tokens) if isinstance(tokens, str) else tokens)
