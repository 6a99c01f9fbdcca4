"""Projections and filters.

All are narrow transformations except the sample guard (a count per group)
and the universe filters (a semi / anti join against a ticker dimension).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Names treated as identifiers, never scaled (fixed values).
ID_LIKE = ["id", "index", "date", "timestamp"]


def time_split(df: DataFrame, cut: str, time: str = "date") -> tuple[DataFrame, DataFrame]:
    """train = time < cut, test = time >= cut. Both predicates reach the
    Parquet scan when ``time`` is a stored column."""
    c = F.lit(cut).cast("date")
    return df.filter(F.col(time) < c), df.filter(F.col(time) >= c)


def tag_split(df: DataFrame, cut: str, time: str = "date") -> DataFrame:
    return df.withColumn("split", F.when(F.col(time) < F.lit(cut).cast("date"), "train").otherwise("test"))


def existing(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The listed columns that exist, in list order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    """P5."""
    return df.dropna(subset=[label])


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with no NULL in any (listed) column."""
    return df.dropna(how="any", subset=list(cols) if cols else None)


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P7."""
    return df.fillna(0.0, subset=list(cols))


def sample_guard(df: DataFrame, by: Sequence[str], min_rows: int) -> DataFrame:
    """P10: the groups with at least ``min_rows`` rows, with their counts."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") >= min_rows))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns minus id-like names."""
    drop = set(ID_LIKE) | set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in drop]


def universe_semi(df: DataFrame, universe: DataFrame, key: str = "ticker") -> DataFrame:
    """Keep tickers listed in the universe dimension (left-semi join).

    The dimension is deduplicated first; Spark picks broadcast from its size
    estimate, and the semi join never multiplies panel rows.
    """
    return df.join(universe.select(key).distinct(), key, "left_semi")


def universe_anti(df: DataFrame, universe: DataFrame, key: str = "ticker") -> DataFrame:
    """Drop tickers listed in the dimension (left-anti join)."""
    return df.join(universe.select(key).distinct(), key, "left_anti")
