"""Inputs made from the given tables, and the registered queries with their SQL."""

from . import analytics_queries, reconcile_queries, text_queries  # noqa: F401  (importing registers)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
