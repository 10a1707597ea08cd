"""Registered queries and the jobs they are made of."""

from . import catalog_queries, more_queries, retrieval_queries, scalar_queries, security_queries, store_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
