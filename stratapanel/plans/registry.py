"""Named queries and the SQL each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query and, where SQL can say the same, its twin."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def view(name: str, sql: str) -> None:
    """Register a derived table used by the SQL twins."""
    VIEWS[name] = sql


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in VIEWS:
        if re.search(rf"\b{name} AS \(", sql):  # the statement defines it itself
            continue
        if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """Put the derived tables a statement reads in front of it."""
    body = sql.strip()
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _needed(body, [])]
    recursive = ""
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        recursive = "RECURSIVE " if head.group(1) else ""
        body = body[head.end():]
        return f"WITH {recursive}" + ",\n".join([*parts, body])
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


# Compared numbers are cut to a fixed number of digits at the very end. The cut point sits off
# the decimal grid (0.3 instead of 0.5), so values that are exact decimals, or exact halves of
# the last digit, are never on it and the order of additions cannot change the result.
def cut(value: Column, digits: int = 6) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale + 0.3) / scale


def qcut(expr: str, digits: int = 6) -> str:
    scale = f"{10**digits}.0"
    return f"(floor(CAST(({expr}) AS DOUBLE) * CAST({scale} AS DOUBLE) + CAST(0.3 AS DOUBLE)) / CAST({scale} AS DOUBLE))"


def long(value: Column) -> Column:
    return value.cast("long")
