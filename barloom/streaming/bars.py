"""An extra beyond the batch engine: OHLC bars of an event stream in tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, width: str = "1 day", late: str = "1 day", key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """symbol, bar_start, open, high, low, close, volume. Works on a stream and, without the watermark's effect, on a table."""
    tick = F.struct(F.col(ts).alias("at"), F.col(value).alias("price"))
    bars = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.col(key).cast("string").alias("symbol"), F.window(ts, width).alias("w")).agg(
        F.min(tick)["price"].alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max(tick)["price"].alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")
