"""Query registry and the shared SQL bindings of the domain tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BINDINGS: dict[str, str] = {}


def binding(name: str, sql: str) -> None:
    """SQL twin of a domain table; may use other bindings by name."""
    BINDINGS[name] = sql


def expand(sql: str) -> str:
    """Prefixes the bindings a statement uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in BINDINGS:
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text) and name not in order:
                visit(BINDINGS[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ", ".join(f"{n} AS ({BINDINGS[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(key: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under a key, with SQL where it exists."""

    def add(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = expand(sql)
        return fn

    return add
