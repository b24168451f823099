"""Every registered query of the log engine, and its SQL."""

from __future__ import annotations

from .plans import queries, store_queries  # noqa: F401  registers its queries

QUERIES = queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL
