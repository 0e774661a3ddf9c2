"""Registered queries: each operator on the given tables, with an equivalent SQL text."""

from __future__ import annotations

from trendloom.plans import (  # noqa: F401  (importing registers the queries)
    cleaning,
    clustering,
    incremental,
    lookups,
    monthly,
    tables,
    topics,
    vectors,
)
from trendloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
