"""Runnable queries over the driver tables, each next to the SQL it must agree with."""

from mediawatch.plans import detail, guide, health, lifecycle, matching, recordings, retrieval, similarity, sources, texts, times  # noqa: F401  (registration)
from mediawatch.plans.registry import ORACLES, QUERIES  # noqa: F401
