"""Queries of the library over the given tables, each with its SQL."""

from __future__ import annotations

from ampledger.plans import core, costs, inputs

QUERIES = core.QUERIES | costs.QUERIES | inputs.QUERIES
SQL = core.SQL | costs.SQL | inputs.SQL

__all__ = ["QUERIES", "SQL"]
