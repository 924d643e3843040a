"""From documents to token ids: quality rules, near duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns the columns of ``documents``; the last returns tokens.  ``run`` writes every
stage to the shared folder and reads it again, so a lost executor costs a stage's task
and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.llm import bpe, decontaminate, jaccard, quality_rules, secrets
from docsieve.llm.registry import table
from docsieve.session import materialise, ship_package


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a rule learned from ``labels`` go."""
    ship_package(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.8 the smallest doc_id stays."""
    ship_package(spark)
    return jaccard.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty in windows of ``benchmark`` go."""
    ship_package(spark)
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in a text is replaced by a mark."""
    ship_package(spark)
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (unsigned 32-bit little-endian) and the digests of ids and decoded bytes."""
    ship_package(spark)
    return bpe.encode_texts(docs, bpe.default_ranks(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", keep_good_documents),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", remove_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", encode),
]
#: SQL can state neither the learned rules nor the encoding; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
