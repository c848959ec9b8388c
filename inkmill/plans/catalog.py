"""All queries over the library's own operators, by name."""

from __future__ import annotations

from inkmill.plans import conversation, derived, edits, metadata, ocr, records, relational, retrieval, streams, text, workflow, rounds, search, library  # noqa: F401
from inkmill.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
