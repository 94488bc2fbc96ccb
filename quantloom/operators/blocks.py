"""Indicators of symbols that are too long for one task: windows and recurrences over blocks of a symbol's bars.

A symbol's bars in order of their dates are cut into blocks of equal size. Each block takes the rows right before it along as a halo, as many as the
longest window looks back and as an exponential mean remembers to the precision of a double, so a block is worked on alone. Sums from a symbol's
first bar on are made within each block, and the blocks before are added as a carry.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.tables import cut, ranked
from quantloom.operators import indicators as ind

#: Rows that the windows of the table of indicators look back, lags included.
LOOK_BACK = 64


def memory(span: int) -> int:
    """Rows after which a bar's weight in an exponential mean is below the precision of a double."""
    return math.ceil(math.log(1e-18) / math.log(1.0 - 2.0 / (span + 1)))


def with_halo(bars: DataFrame, size: int, halo: int) -> DataFrame:
    """Bars by block: ``block``, and ``own``, which is false for the last ``halo`` rows of the block before, that come along. Positions are by ranges of (symbol, date),
    which must be unique, so no task has a symbol whole."""
    if not 0 <= halo <= size:
        raise ValueError("a halo is no longer than a block")
    rows = ranked(bars, ["symbol"], ["date"])
    at = F.floor(F.col("rank") / size)
    twice = (F.col("rank") % size >= size - halo) & ((at + 1) * size < F.col("total"))
    rows = rows.withColumn("block", F.explode(F.when(twice, F.array(at, at + 1)).otherwise(F.array(at))))
    return rows.withColumn("own", F.col("block") == at).drop("rank", "total")


def carries(blocks: DataFrame, sums: dict[str, str]) -> DataFrame:
    """For each (symbol, block) the sums of what its symbol's earlier blocks have in the columns ``sums``, under their new names. Blocks are few rows."""
    totals = blocks.groupBy("symbol", "block").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("symbol", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(out) for c, out in sums.items()])


def long_indicators(bars: DataFrame, shift: int = 1, size: int = 1 << 16) -> DataFrame:
    """The table of indicators.indicators(), to the precision of doubles, in tasks of about ``size`` bars, however many a symbol has.

    Bars with one (symbol, date) twice have no order, as there. The halo costs (some 1,300 rows) / ``size`` of the work. Bars are written
    once, by ranges, and read by blocks; sums by block, a row each, are what is carried on."""
    halo = LOOK_BACK + memory(50) + memory(9) + shift
    size = max(size, halo)
    rows = cut(with_halo(bars, size, halo), "blocks")
    names = [c for c in bars.columns if c != "symbol"]
    # Within a block all is as for a symbol, so a block stands in for one.
    df = rows.withColumn("symbol", F.struct("symbol", "block")).drop("block")
    move = F.coalesce(F.signum(F.col("close") - ind.lag("close")), F.lit(0.0)) * F.col("volume")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    parts = {"__signed": move, "__worth": typical * F.col("volume"), "__volume": F.col("volume").cast("double")}
    df = df.withColumns({c: F.when(F.col("own"), x) for c, x in parts.items()})
    sums = cut(carries(df.select("symbol.symbol", "symbol.block", *parts), {c: f"{c}_before" for c in parts}), "carries")
    df = df.withColumns({f"sma_{n}": ind.sma(n) for n in (5, 20, 50)})
    for step in (ind.rsi, ind.stochastic, ind.adx, ind.bollinger, ind.atr, ind.returns, ind.roc, ind.cci, ind.williams_r):
        df = step(df)
    upto = ind.by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({c: F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for c in parts})
    e = ind.Ema(df).add("close", {f"ema_{n}": n for n in (12, 26, 50)})
    e = ind._macd(e, "ema_12", "ema_26")
    new = [c for c in e.df.columns if c not in (*names, "symbol", "own", "__pos", "__block", "__k")]
    later = e.df.select("symbol", *names, "own", *[(F.lag(c, shift).over(e.rows) if shift else F.col(c)).alias(c) for c in new])
    out = later.where("own").select("symbol.symbol", "symbol.block", *names, *new)
    # A block's key has its rows only, so the join is left to Spark.
    out = out.join(sums, ["symbol", "block"])
    total = {c: F.col(c) + F.col(f"{c}_before") for c in parts}
    out = out.withColumns({"obv": total["__signed"], "vwap": total["__worth"] / F.nullif(total["__volume"], F.lit(0.0))})
    first = [c for c in new if c not in parts]
    return out.select("symbol", *names, *first, "obv", "vwap")
