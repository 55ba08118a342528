"""Registered queries of the engine and the SQL that states the same results."""

from __future__ import annotations

from quern.plans import changes, codebase, crawl, extract, failures, health, history, joins, machines, merge, pagebinding, pages, planner, rollups, scalars, scores, scoring, signals, site, stream, validation, web  # noqa: F401  they register
from quern.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
