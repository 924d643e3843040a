"""Registered queries over the given tables, each with its SQL answer."""

from . import aggregate_queries, io_queries, model_queries, row_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
