"""All registered queries and their checks."""

from __future__ import annotations

from . import answer_queries, corpus_queries, retrieval_queries, support_queries  # noqa: F401
from .registry import ORACLES, QUERIES, oracle_text

__all__ = ["QUERIES", "oracle_sql"]


def oracle_sql() -> dict[str, str]:
    return {name: oracle_text(sql) for name, sql in ORACLES.items()}
