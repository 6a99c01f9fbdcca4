"""Bars from raw trades (S11) and the panels derived from the driver tables.

``ohlcv_bars`` is the one ingest step the reference does not have (it buys
daily bars); here raw rows are aggregated into one bar per (key, day).
Every aggregate is decomposable (min_by / max_by / min / max / sum), so
Spark combines map-side before the shuffle and a hot (key, day) group costs
one partial row per input partition, not one task holding all its trades.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture roles of the order priorities (fixed values, see FIXTURES.md §4):
# broad index, ETF, volatility index.
BENCHMARKS = {"broad": "1-URGENT", "etf": "2-HIGH", "vol": "3-MEDIUM"}


def ohlcv_bars(df: DataFrame, key: str, ts: str, price: str, volume: str,
               tiebreak: Sequence[str], out_key: str = "ticker") -> DataFrame:
    """One OHLCV bar per (key, day); open / close are the first / last trade by
    ``tiebreak`` (a unique trade order within the day)."""
    order = trade_order(tiebreak)
    return (
        df.groupBy(F.col(key).alias(out_key), F.to_date(F.col(ts)).alias("date"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum(volume).alias("volume"),
        )
    )


# Digits that the parts of a trade order may have (non-negative whole numbers).
ORDER_DIGITS = {"l_orderkey": 15, "l_linenumber": 3, "l_partkey": 10, "l_suppkey": 10}


def trade_order(tiebreak: Sequence[str]) -> Column:
    """The order of trades as one value. Whole numbers with known digits are
    packed into a DECIMAL(38), which a hash aggregate can update in place; a
    struct would make Spark sort all trades. Too large a number is an error,
    not a wrong order."""
    if not all(c in ORDER_DIGITS for c in tiebreak):
        return F.struct(*[F.col(c) for c in tiebreak])
    out = F.lit(0).cast("decimal(38,0)")
    below = sum(ORDER_DIGITS[c] for c in tiebreak)
    for c in tiebreak:
        below -= ORDER_DIGITS[c]
        part = F.col(c).cast(f"decimal({ORDER_DIGITS[c]},0)")
        out = (out + part * F.lit("1" + "0" * below).cast(f"decimal({below + 1},0)")).cast("decimal(38,0)")
    return out


def trade_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trades of the fixture: lineitem priced per unit, ticker = part brand.

    No broadcast hint: part grows with the data, so the join strategy is left
    to Spark's size-checked planner and AQE.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_shipdate")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .select(
            F.col("p_brand").alias("ticker"),
            F.col("l_shipdate").alias("ts"),
            (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("px"),
            F.col("l_quantity").alias("qty"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )
    )


TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def stock_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per brand: ticker, date, open, high, low, close, volume."""
    return ohlcv_bars(trade_ticks(spark, sf_dir), "ticker", "ts", "px", "qty", TICK_ORDER)


def stock_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bar panel in canonical shape; there are no splits, so adj = close."""
    return stock_bars(spark, sf_dir).withColumn("adj_close", F.col("close"))


def benchmark_series(spark: SparkSession, sf_dir: str,
                     tickers: Sequence[str] | None = None) -> DataFrame:
    """Daily benchmark closes (ticker, date, close) with holiday gaps."""
    tickers = list(tickers or BENCHMARKS.values())
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return (
        o.filter(F.col("o_orderpriority").isin(tickers))
        .groupBy(F.col("o_orderpriority").alias("ticker"),
                 F.to_date("o_orderdate").alias("date"))
        .agg((F.floor(F.avg("o_totalprice") * 100) / 100).alias("close"))
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, short panel: one bar per (event_type, day) of ``events``."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ohlcv_bars(ev, "event_type", "ts", "value", "value", ["ts", "event_id"])
