"""Registered queries of the core operators."""

from __future__ import annotations

from docmill.plans import chart_plans, document_plans, extra_plans, ingest_plans, more_plans, search_plans  # noqa: F401  (they register themselves)
from docmill.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
