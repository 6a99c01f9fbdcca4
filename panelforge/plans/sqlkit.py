"""Small builders for the DuckDB oracle SQL.

The oracle is written by hand per query; these helpers only spell out the
recurring window clauses so each statement stays readable.
"""

from __future__ import annotations

PART = "PARTITION BY ticker ORDER BY date"


def win(n: int | None = None, part: str = PART) -> str:
    if n is None:
        return f"({part})"
    return f"({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, part: str = PART) -> str:
    """Full-frame rolling aggregate: NULL unless all n rows are non-null."""
    w = win(n, part)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END"


def lag(x: str, n: int = 1, part: str = PART) -> str:
    return f"lag({x}, {n}) OVER ({part})"


def lead(x: str, n: int = 1, part: str = PART) -> str:
    return f"lead({x}, {n}) OVER ({part})"


def sdiv(a: str, b: str) -> str:
    """Division with NULL for a zero denominator."""
    return f"(({a}) / nullif(({b}), 0))"


def r6(x: str, alias: str, d: int = 6) -> str:
    return f"round({x}, {d}) + 0.0 AS {alias}"


def rcols(cols, d: int = 6, overrides: dict[str, int] | None = None) -> str:
    overrides = overrides or {}
    return ", ".join(f"round({c}, {overrides.get(c, d)}) + 0.0 AS {c}" for c in cols)
