"""Registered queries over the operators, with equivalent SQL."""

from __future__ import annotations

from . import documentation, execution, ingest, layouts, matching, quality, reports, rules, streams
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "documentation", "execution", "ingest", "layouts", "matching", "quality", "reports", "rules", "streams"]
