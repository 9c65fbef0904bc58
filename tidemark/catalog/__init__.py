"""Named queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
