"""All queries over the reference tables, by name, each with its SQL oracle where one exists."""

from __future__ import annotations

from . import alignment_queries, analysis_queries, format_queries, interval_queries, more_queries, sequence_queries

PARTS = [interval_queries, sequence_queries, analysis_queries, format_queries, alignment_queries, more_queries]


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.Q.items()}


def oracle_sql() -> dict:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
