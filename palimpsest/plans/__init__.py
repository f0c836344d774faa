"""Queries that bind the operators to the driver's tables, with their SQL oracles."""

from palimpsest.plans import aggregates, filters, joins, population, priors, quality, ranking, resolve, scans, scoring, sets, streams, temporal, texts  # noqa: F401
from palimpsest.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
