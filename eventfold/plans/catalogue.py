"""The query catalogue: every query by name, and its SQL."""

from __future__ import annotations

from eventfold.plans import forecast, operations, processing, projection, streams  # noqa: F401
from eventfold.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
