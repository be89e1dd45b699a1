"""All queries of the engine proper, keyed by their row of the operator inventory."""

from __future__ import annotations

from tessera.plans import geometry, graph, relational, statistics, storage
from tessera.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "geometry", "graph", "relational", "statistics", "storage"]
