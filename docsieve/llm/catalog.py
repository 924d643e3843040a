"""Imports every operator module, which registers its query."""

from . import bpe, decontaminate, hard_negatives, jaccard, language_model, lexical_search, licenses, quality_rules, secrets, syncmers, url_reputation, warc, wordpiece  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
