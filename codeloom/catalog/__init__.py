"""Registered queries over the given tables, with their SQL equivalents."""

from codeloom.catalog import (  # noqa: F401
    extraction,
    graphs,
    jobs,
    joins,
    labels,
    rankings,
    scores,
    totals,
)
from codeloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
