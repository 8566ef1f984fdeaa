"""The library's registered queries and their DuckDB equivalents."""

from __future__ import annotations

from .plans import checks, graphs, intake, reads, streams, transfer  # noqa: F401  (they register their queries)
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
