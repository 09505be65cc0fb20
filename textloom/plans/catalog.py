"""All queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from textloom.plans import corpus, evaluation, pipelines, sequences

_PARTS = (corpus, sequences, evaluation, pipelines)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
