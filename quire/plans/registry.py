"""Queries over the driver tables and their SQL."""

from __future__ import annotations

from quire.plans import hierarchy, inventory, retrieval, sectioning, training
from quire.plans.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "hierarchy", "inventory", "retrieval", "sectioning", "training"]
