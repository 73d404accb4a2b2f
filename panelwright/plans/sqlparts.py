"""Fragments of SQL: ranks, correlations, rounding."""

from __future__ import annotations


def ar(x: str, keys: str) -> str:
    """Average rank in SQL."""
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"


def pr(x: str, keys: str) -> str:
    return f"({ar(x, keys)} / count({x}) OVER (PARTITION BY {keys}))"


def corr(a: str, b: str) -> str:
    return f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 1e-15 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"
