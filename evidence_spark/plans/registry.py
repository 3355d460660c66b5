"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import ROLE_SQL, Roles, duck_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARED: dict[str, str] = {}  # named sub-queries used by several checks


def query(name: str, sql: str | None = None):
    """Registers ``fn(roles)`` as a query; ``sql`` is its DuckDB equivalent."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Roles(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def oracle_text(sql: str) -> str:
    """The check with the role views and shared parts it mentions, in dependency order."""
    pool = {**ROLE_SQL, **SHARED}
    done: list[str] = []

    def visit(text: str):
        for name in pool:
            if name not in done and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(pool[name])
                if name not in done:
                    done.append(name)

    visit(sql)
    if not done:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({duck_text(pool[n]).strip()})" for n in done)
    return f"WITH {ctes}\n{sql.strip()}"


def ln(label: str, expr: str) -> str:
    return f"CASE WHEN trim(coalesce({expr}, '')) <> '' THEN concat('{label}: ', trim({expr})) END"


def lns(head: str, *pairs) -> str:
    return "concat_ws(chr(10), '" + head + "', " + ", ".join(ln(a, b) for a, b in pairs) + ")"


def any_term(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in terms) + ")"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"
