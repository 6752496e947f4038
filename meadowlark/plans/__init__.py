"""Registered queries over the driver's tables and those derived from them."""

from . import scalar_queries, search_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
