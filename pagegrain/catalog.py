"""All registered queries of the library and their DuckDB oracles."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.page_oracles import PAGE_ORACLES
from .plans.registry import QUERIES, flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return ORACLES | PAGE_ORACLES
