"""Decision features: states of trend, volatility and momentum, from unlagged indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import indicators as ind

#: Values that a percentile needs, and the thresholds used with fewer.
LEAST, FALLBACK = 30, (30.0, 50.0, 70.0)


def cross(fast: Column, slow: Column, up: str, down: str) -> Column:
    return F.when(fast.isNull() | slow.isNull(), "").when(fast > slow, up).when(fast < slow, down).otherwise("neutral")


def _points(c: str) -> dict[str, Column]:
    """Whether a column has enough values, and its 25, 50 and 75 percent points, as aggregates."""
    return {f"{c}_enough": F.count(c) >= LEAST, f"{c}_p": F.percentile(c, [0.25, 0.5, 0.75])}


def _picked(c: str) -> dict[str, Column]:
    """The points of _points(), or the fallback without enough values."""
    return {f"{c}_p{q}": F.when(F.col(f"{c}_enough"), F.col(f"{c}_p")[k]).otherwise(FALLBACK[k]) for k, q in enumerate((25, 50, 75))}


def thresholds(df: DataFrame, cols: list[str], pooled: DataFrame | None = None) -> DataFrame:
    """25, 50 and 75 percent points of each column by symbol, over both sources if two are given; and whether there are enough values."""
    rows = df.select("symbol", *cols) if pooled is None else df.select("symbol", *cols).unionByName(pooled.select("symbol", *cols))
    p = rows.groupBy("symbol").agg(*[x.alias(name) for c in cols for name, x in _points(c).items()])
    return p.select("symbol", *[f"{c}_enough" for c in cols], *[x.alias(name) for c in cols for name, x in _picked(c).items()])


def rsi_bin(col: str) -> Column:
    v = F.col(col)
    lo, mid, hi = (F.col(f"{col}_p{q}") for q in (25, 50, 75))
    return F.when(v.isNull(), "").when(v > hi, "highly overbought").when(v > mid, "slightly overbought").when(v < lo, "highly oversold").when(v < mid, "slightly oversold").otherwise("neutral")


def decision_features(bars: DataFrame) -> DataFrame:
    """Eleven columns of states."""
    df = ind.bollinger(ind.rsi(ind.rsi(bars, 7), 14)).withColumns({f"__sma_{n}": ind.sma(n) for n in (5, 20, 50)})
    df = ind.Ema(df).add("close", {f"__ema_{n}": n for n in (12, 26, 50)}).done()
    width = F.col("bb_upper") - F.col("bb_lower")
    df = df.withColumns({"__pb": (F.col("close") - F.col("bb_lower")) / F.nullif(width, F.lit(0.0)), "__bw": width / F.nullif(F.col("bb_middle"), F.lit(0.0))})
    # The thresholds of thresholds(), over each symbol's rows where they are.
    own, cols = Window.partitionBy("symbol"), ("rsi_7", "rsi_14", "__bw")
    df = df.withColumns({f"{c}_enough": F.count(c).over(own) >= LEAST for c in cols} | {f"{c}_p": _points(c)[f"{c}_p"].over(own) for c in cols})
    df = df.withColumns({name: x for c in cols for name, x in _picked(c).items()})
    trend = F.when(F.col("__pb").isNull(), "").when(F.col("__pb") > 0.6, "bullish").when(F.col("__pb") < 0.4, "bearish").otherwise("neutral")
    obos = F.when(F.col("__pb").isNull(), "").when(F.col("__pb") >= 1.0, "overbought").when(F.col("__pb") <= 0.0, "oversold").otherwise("neutral")
    vol = F.when(F.col("__bw").isNull(), "").when(~F.col("__bw_enough"), "normal volatility").when(F.col("__bw") > F.col("__bw_p75"), "high volatility").when(F.col("__bw") < F.col("__bw_p25"), "low volatility").otherwise("normal volatility")
    c = F.col
    return df.select(
        *bars.columns, F.round("rsi_7", 2).alias("rsi_7"), cross(c("__sma_5"), c("__sma_20"), "bullish", "bearish").alias("sma_5_20"), cross(c("__sma_20"), c("__sma_50"), "strong bullish", "strong bearish").alias("sma_20_50"),
        cross(c("__ema_12"), c("__ema_26"), "bullish", "bearish").alias("ema_12_26"), cross(c("__ema_26"), c("__ema_50"), "long-term bullish", "long-term bearish").alias("ema_26_50"),
        F.array_join(F.filter(F.array(trend, obos, vol), lambda x: x != ""), " | ").alias("bb_indicator"), trend.alias("bb_trend_state"), vol.alias("bb_volatility_state"), obos.alias("bb_overbought_oversold"),
        rsi_bin("rsi_7").alias("rsi_indicator_7"), rsi_bin("rsi_14").alias("rsi_indicator_14"),
    )
