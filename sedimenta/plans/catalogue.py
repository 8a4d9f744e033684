"""The named queries and the SQL each is checked against."""

from __future__ import annotations

from . import code, extraction, flows, health, indexes, joins, lookups, maintenance, projects, search, services, text  # noqa: F401  (each registers its queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
