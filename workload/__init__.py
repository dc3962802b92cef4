"""Queries over the test tables, one per operator, with their SQL where SQL can state them."""

from __future__ import annotations

from workload.registry import QUERIES, SQL, Query


def _load() -> None:
    from workload import cases, checks, describe, models, scans  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
