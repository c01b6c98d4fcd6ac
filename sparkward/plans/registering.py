"""Where queries and their DuckDB counterparts register, and the SQL pieces that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkward.functions import rules
from sparkward.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END"


def values(rows) -> str:
    """A list of VALUES from Python rows."""
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "E'" + x.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def matches_any(column: str, table: tuple, heuristic: bool) -> str:
    """Whether any rule of the table (and of the heuristic) matches the column."""
    patterns = [p for _, p in table] + (list(rules.HEURISTIC_PATTERNS) if heuristic else [])
    return "(" + " OR ".join(f"regexp_matches({column}, '(?im)" + p.replace("'", "''") + "')" for p in patterns) + ")"
