"""The registered queries of the reference's operators, and their SQL."""

from __future__ import annotations

from .operators import audit, changes, discovery, documents, hierarchy, relational, scalar_queries, search  # noqa: F401
from .plans import feeds, metadata_queries, migration  # noqa: F401
from .plans.registry import QUERIES, SQL, Query
from .streaming import capture, late, polling  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
