"""All queries of the library; importing the modules registers them."""

from __future__ import annotations

from tessera.plans import announcements, changes, documents, envelopes, evidence, feeds, files, guides, history, legacy, listings, matching, notices, personal, planning, ranking, relational, sources, summaries, texts, upkeep, worded  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
