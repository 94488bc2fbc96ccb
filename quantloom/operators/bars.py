"""Bars from trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars_from_trades(trades: DataFrame, parts: int | None = None) -> DataFrame:
    """Bars by (symbol, date) from price, qty and a total order ``seq``: open and close are the prices of the first and last
    trade, high and low the extremes, the volume their sum. Sums and extremes are pre-aggregated before the shuffle.

    Where many symbols have few trades a day, that makes nothing smaller. With ``parts`` trades are dealt by symbol to so many
    partitions instead, and bars and whatever goes by symbol after them need no other exchange; a symbol's trades are one task's then."""
    if parts:
        trades = trades.repartition(parts, "symbol")
    return trades.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("qty").alias("volume")
    )
