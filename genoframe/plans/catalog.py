"""Queries over the driver's tables, by operator ID, with the SQL that must agree with each."""

from __future__ import annotations

from genoframe.plans import comparisons, files, genotypes, geometry, iterative, records, scores, search, statistics, training  # noqa: F401
from genoframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
