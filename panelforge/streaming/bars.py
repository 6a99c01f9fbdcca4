"""Incremental daily bars (S11 over a stream of trades).

The same aggregation as ``sources.bars.ohlcv_bars``, declared on a
``readStream`` source: a watermark on the trade time bounds the state to the
open days, and each day's bar is final once the watermark passes its end
(append mode), so downstream panel stages can consume bars as files land.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def trade_stream(spark: SparkSession, directory: str, schema: StructType,
                 file_glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files of trades arriving in ``directory``."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


def stream_bars(trades: DataFrame, key: str, ts: str, price: str, volume: str,
                tiebreak: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """Daily OHLCV per key with a watermark of ``lateness`` on the trade time."""
    order = F.struct(*[F.col(c) for c in tiebreak])
    # watermarks need TIMESTAMP; files without a zone read as TIMESTAMP_NTZ
    trades = trades.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        trades.withWatermark(ts, lateness)
        .groupBy(F.col(key).alias("ticker"), F.window(ts, "1 day").alias("day"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"),
             F.min(price).alias("low"), F.max_by(price, order).alias("close"),
             F.sum(volume).alias("volume"))
        .select("ticker", F.to_date("day.start").alias("date"), "open", "high", "low", "close", "volume")
    )


def write_bars(bars: DataFrame, path: str, checkpoint: str, mode: str = "append",
               available_now: bool = True) -> StreamingQuery:
    """Append final bars to Parquet; the checkpoint folder makes the query
    restartable after a failure without losing or repeating bars."""
    w = bars.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.format("parquet").start(path)
