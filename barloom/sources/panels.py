"""Panels derived from transaction tables: bars by supplier and month or week, by user and day, and by event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def bars_lineitem(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """Bars of a supplier's unit prices: first, highest, lowest and last price of the period, quantity and value."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct(*ORDER)
    src = lines.select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.date_trunc(unit, "l_shipdate").cast("date").alias("trade_date"),
        F.struct(order.alias("at"), price.alias("price")).alias("tick"), price.alias("price"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
    )
    return src.groupBy("symbol", "trade_date").agg(
        F.min("tick")["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max("tick")["price"].alias("close"),
        F.sum("quantity").alias("volume"), F.sum("value").cast("double").alias("amount"),
    )


def bars_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a user's event values by day; volume counts events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tick = F.struct("ts", "event_id", "value")
    return events.groupBy(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("date").alias("trade_date")).agg(
        F.min(tick)["value"].alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(tick)["value"].alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each event, in the order of event_id (as trade_date). A third of the users are one symbol, which holds a third of all rows."""
    symbol = F.when(F.col("user_id") % 3 == 0, F.lit("all")).otherwise(F.col("user_id").cast("string"))
    prices = [F.col("value").alias(c) for c in ("open", "high", "low", "close")]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(symbol.alias("symbol"), F.col("event_id").alias("trade_date"), *prices, F.lit(1.0).alias("volume"))
