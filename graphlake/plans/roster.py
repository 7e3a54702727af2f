"""Every registered query of the graph engine, by name, with its SQL where SQL expresses it."""

from __future__ import annotations

from graphlake.plans.queries import ALL as QUERIES
from graphlake.plans.sql import SQL as ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
