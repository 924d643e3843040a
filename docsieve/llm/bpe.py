"""Byte-level BPE encoding and decoding with a local rank file.

The tokenizer library does the merging.  Long texts are cut before encoding, only
where the split pattern is sure to cut as well, so the ids are those of the whole
text: between a letter or digit and a following space or line feed no pattern
match can run on, and none looks back.  Runs of white space too long for the
library's regular expression become the pieces the pattern would make of them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .registry import query, table

CHUNK = 1 << 16
LONG_GAP = 1 << 15
_GAP = regex.compile(r"\p{White_Space}{%d,}" % LONG_GAP)
_SAFE = regex.compile(r"[\p{L}\p{N}](?=[ \n])")


@lru_cache(maxsize=4)
def encoding(rank_file: str):
    """The library's encoding for a rank file; without a path, the file of that name that Spark shipped."""
    import public_tokenizers
    import tiktoken

    path = rank_file if "/" in rank_file else SparkFiles.get(rank_file)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, chunk: int = CHUNK) -> Iterator[tuple[bool, str]]:
    """(whole, part): parts that concatenate to ``text``; a whole one is one match of the pattern."""
    at = 0
    if len(text) >= LONG_GAP:
        for gap in _GAP.finditer(text):
            start, end = gap.span()
            end -= end < len(text)  # the last one goes with what follows
            for part in _chunks(text, at, start, chunk):
                yield False, part
            yield True, text[start:end]
            at = end
    for part in _chunks(text, at, len(text), chunk):
        yield False, part


def _chunks(text: str, start: int, end: int, chunk: int) -> Iterator[str]:
    while end - start > chunk:
        safe = _SAFE.search(text, start + chunk - 1, end)
        if safe is None:
            break
        yield text[start : safe.end()]
        start = safe.end()
    if end > start:
        yield text[start:end]


def encode(enc, text: str, chunk: int = CHUNK) -> Iterator[list[int]]:
    """The ids of a text, a chunk at a time."""
    for whole, part in pieces(text, chunk):
        yield enc._encode_single_piece(part) if whole else enc.encode_ordinary(part)


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes of ids; a chunk may end inside a character."""
    return enc.decode_bytes(ids)


def _ship(spark: SparkSession, rank_file: str) -> str:
    """Send the rank file to every worker, once; the name under which workers find it."""
    shipped = spark.sparkContext.__dict__.setdefault("_docsieve_ranks", {})
    if rank_file not in shipped:
        spark.sparkContext.addFile(rank_file)
        shipped[rank_file] = rank_file.rsplit("/", 1)[-1]
    return shipped[rank_file]


def encode_texts(
    docs: DataFrame,
    rank_file: str,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    keep_ids: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """The ``keep`` columns, n_tokens, ids, ids_sha256 and decoded_sha256, one row per input row.

    ``ids`` (absent with ``keep_ids=False``) are unsigned 32-bit little-endian
    integers in one binary value.  The digests are of those bytes and of the bytes
    the ids decode to.  A null text counts as empty; null and repeated ids stay as
    they are; columns besides ``keep`` and ``text`` are not read.
    """
    name = _ship(docs.sparkSession, rank_file)
    kept_columns = [docs[c].alias(f"k{i}") for i, c in enumerate(keep)]
    columns = docs.select(docs[text].cast("string").alias("t"), *kept_columns)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name)
        for batch in stream:
            count, ids_hash, bytes_hash, ids = [], [], [], []
            for value in batch.column(0):
                n, of_ids, of_bytes, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for part in encode(enc, value.as_py() or "", chunk):
                    raw = np.array(part, dtype="<u4").tobytes()
                    n += len(part)
                    of_ids.update(raw)
                    of_bytes.update(decode(enc, part))
                    if keep_ids:
                        kept.append(raw)
                count.append(n)
                ids_hash.append(of_ids.hexdigest())
                bytes_hash.append(of_bytes.hexdigest())
                ids.append(b"".join(kept))
            out = {f"k{i}": batch.column(i + 1) for i in range(len(keep))} | {"n_tokens": pa.array(count, pa.int64())}
            if keep_ids:
                out["ids"] = pa.array(ids, pa.binary())
            out |= {"ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(bytes_hash, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    kept = "".join(f"k{i} {columns.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    schema = f"{kept}n_tokens long{', ids binary' * keep_ids}, ids_sha256 string, decoded_sha256 string"
    return columns.mapInArrow(batches, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def decode_texts(encoded: DataFrame, rank_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from ``encode_texts``; bytes that are no UTF-8 become U+FFFD, null ids a null text."""
    name = _ship(encoded.sparkSession, rank_file)
    columns = encoded.select(encoded[key].alias("k"), encoded[ids].alias("i"))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name)
        for batch in stream:
            texts = [
                None if v is None else decode(enc, np.frombuffer(v, dtype="<u4").tolist()).decode("utf-8", "replace")
                for v in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"k": batch.column(0), "text": pa.array(texts, pa.string())})

    schema = f"k {columns.schema['k'].dataType.simpleString()}, text string"
    return columns.mapInArrow(batches, schema).withColumnRenamed("k", key)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), default_ranks(), keep_ids=False)
