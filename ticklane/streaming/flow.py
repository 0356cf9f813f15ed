"""The segment flow as a stream: windows by event time with a watermark; late rows beyond it are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.functions import exprs as X


def windowed_flow(trades: DataFrame, time: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Amount, known net, unknown amount and complete net by code and window of a stream (or table) of (code, time, side, amount)."""
    grouped = trades.withWatermark(time, lateness).groupBy(F.window(time, width), "code")
    sums = grouped.agg(F.sum("amount").alias("amount"), X.known_net().alias("known_net"), X.unknown_amount().alias("unknown"), F.count("*").alias("trades"))
    return sums.select("code", F.col("window.start").alias("start"), "amount", "known_net", "unknown", X.complete_net("known_net", "unknown").alias("net"), "trades")
