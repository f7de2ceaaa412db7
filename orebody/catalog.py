"""All engine queries and their SQL."""

from __future__ import annotations

from . import oracle, oracle_moves, oracle_plans, queries, queries_moves, queries_plans

QUERIES = queries.QUERIES | queries_plans.QUERIES | queries_moves.QUERIES
ORACLE = oracle.ORACLE | oracle_plans.ORACLE | oracle_moves.ORACLE
