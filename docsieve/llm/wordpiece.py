"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of bytes.  Every node has a failure link and the number of
tokens that are complete when it is followed, so each byte of a word is read once and
greedy longest-match lengths come out as sums of popped counts; no piece is built.
Words are the matches of the split pattern, with their leading space; their counts
are remembered within a task, up to a bound.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .bpe import _ship, default_ranks
from .registry import query, table

#: Words whose counts a task remembers.
REMEMBERED = 500_000


class LongestMatch:
    """Greedy longest-match token counts over a vocabulary of byte strings.

    ``unknown`` is the count of a word that the vocabulary cannot spell.
    """

    def __init__(self, vocabulary: Iterable[bytes], unknown: int = 1):
        self.unknown = unknown
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                if (child := self.next[node].get(byte)) is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = child
            ends[node] = ends[node] or node > 0
        # Failure link and tokens popped by following it; -1: no way on.
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in self.next[node].items():
                    below.append(child)
                    if ends[child]:
                        self.link[child], self.popped[child] = 0, 1
                        continue
                    at, popped = self.link[node], self.popped[node]
                    while at >= 0 and byte not in self.next[at]:
                        popped += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[child], self.popped[child] = self.next[at][byte], popped
            level = below

    def count(self, word: bytes) -> int:
        """Tokens of a word; an empty one has none."""
        step, link, popped = self.next, self.link, self.popped
        node = total = 0
        for byte in word:
            while (child := step[node].get(byte)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return self.unknown
            node = child
        while node > 0:
            total += popped[node]
            node = link[node]
        return total if node == 0 else self.unknown


@lru_cache(maxsize=2)
def automaton(rank_file: str) -> LongestMatch:
    path = rank_file if "/" in rank_file else SparkFiles.get(rank_file)
    with open(path, "rb") as lines:
        return LongestMatch(base64.b64decode(line.split()[0]) for line in lines)


def count_tokens(docs: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_bytes, n_tokens), one row per input row.

    A null or empty text has no words; a text is never cut; null and repeated keys stay
    as they are; other columns are not read.
    """
    name = _ship(docs.sparkSession, rank_file)
    columns = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        words, machine = regex.compile(public_tokenizers.PATTERN), automaton(name)
        known: dict[str, int] = {}
        for batch in stream:
            rows = []
            for value in batch.column(1):
                whole = value.as_py() or ""
                n = tokens = 0
                for match in words.finditer(whole):
                    word = match[0]
                    n += 1
                    if (found := known.get(word)) is None:
                        found = machine.count(word.encode())
                        if len(word) <= 64:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[word] = found
                    tokens += found
                rows.append((n, len(whole.encode()), tokens))
            n, size, tokens = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict(
                {"k": batch.column(0)}
                | {c: pa.array(v, pa.int64()) for c, v in (("n_words", n), ("n_bytes", size), ("n_tokens", tokens))}
            )

    schema = f"k {columns.schema['k'].dataType.simpleString()}, n_words long, n_bytes long, n_tokens long"
    return columns.mapInArrow(batches, schema).withColumnRenamed("k", key)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_ranks())
