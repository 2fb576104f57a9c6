"""All queries but those of the llm subpackage."""

from __future__ import annotations

from gleaner.plans import field_queries, group_queries, relational_queries, search_queries, value_queries  # noqa: F401  they register their queries
from gleaner.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
