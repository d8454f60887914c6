"""All queries and their SQL by name."""

from __future__ import annotations

from lociframe.plans.queries import QUERIES
from lociframe.plans.sql import oracles


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracles()
