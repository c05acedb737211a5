"""Queries of the engine and the SQL that each is held against."""

from __future__ import annotations

from loomline.plans import aggregates, edits, logs, relational, sequences, stores, texts, vectors  # noqa: F401  they register their queries
from loomline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
