"""Queries over the driver tables, and their SQL."""

from __future__ import annotations

from evidencelake.plans import answers, catalog, contracts, evidence, research, retrieval, review, rules, shared, tenure

_PLANS = (retrieval, research, review, catalog, answers, tenure, evidence, shared, contracts, rules)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
