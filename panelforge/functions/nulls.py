"""Null, NaN and division policy.

Spark 4 runs with ANSI on, so ``x / 0.0`` raises. pandas would give NaN or
+-inf there; we give NULL through ``try_divide`` (0/0 matches, +-inf becomes
NULL: a stated deviation). NaN never enters a panel: in Spark ``NaN > 0`` is
true, while in pandas it is false, so NaN is turned into NULL at ingest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """a / b, NULL when b is 0 or either side is NULL."""
    return F.try_divide(_c(a), _c(b))


def is_true(cond: Column) -> Column:
    """A comparison where NULL counts as false (pandas ``NaN > x`` is False)."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """``(cond).astype(int)`` with NULL → 0."""
    return is_true(cond).cast("int")


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(~F.isnan(c), c)


def clean_doubles(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(nan_to_null(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def rnd(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round floating columns for cross-engine comparison.

    Sums run in a different order in every engine, so results are compared
    after rounding: 6 decimals by default, fewer for large price x volume
    levels. ``+ 0.0`` turns -0.0 into 0.0.
    """
    overrides = overrides or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            d = overrides.get(f.name, digits)
            out.append((F.round(F.col(f.name), d) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(out)

