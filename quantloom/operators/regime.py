"""Market regime, relative strength, beta, calendar and cross-sectional ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.tables import cut, join_keyed, tie_ranks
from quantloom.operators.indicators import by_symbol, lag


def days():
    """The index series has one row a day, so one partition holds it at any number of symbols."""
    return Window.orderBy("date")


def _full(value: Column, of: str, n: int) -> Column:
    return F.when(F.count(of).over(days().rowsBetween(-(n - 1), 0)) == n, value)


def merge_indices(market: DataFrame, volatility: DataFrame) -> DataFrame:
    return market.join(volatility, "date", "full")


def regime(index: DataFrame) -> DataFrame:
    """From date, mkt_close, vol_close: returns, volatility, trend, level, and flags that are 0 where what they compare is null."""
    over = lambda n: days().rowsBetween(-(n - 1), 0)
    ln = F.ln("mkt_close")
    df = index.withColumn("mkt_log_return", ln - F.lag(ln, 1).over(days()))
    sma = {n: _full(F.avg("mkt_close").over(over(n)), "mkt_close", n) for n in (50, 200)}
    df = df.withColumns({
        "mkt_return_20d": F.col("mkt_close") / F.nullif(F.lag("mkt_close", 20).over(days()), F.lit(0.0)) - 1.0,
        "mkt_vol_20d": _full(F.stddev_samp("mkt_log_return").over(over(20)), "mkt_log_return", 20) * math.sqrt(252),
        "mkt_trend": (sma[50] - sma[200]) / F.nullif(sma[200], F.lit(0.0)),
        "vol_level": F.col("vol_close"),
        "vol_delta_5d": F.col("vol_close") - F.lag("vol_close", 5).over(days()),
        "__median": _full(F.percentile("vol_close", 0.5).over(over(252)), "vol_close", 252),
    })
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.withColumns({"regime_high_vol": flag(F.col("vol_level") > F.col("__median")), "regime_up": flag(F.col("mkt_trend") > 0)}).drop("__median", "vol_close")


def attach_regime(bars: DataFrame, index: DataFrame) -> DataFrame:
    """A row a day, written first, so that Spark knows its size and broadcasts it as long as it is small; bars stay by symbol then."""
    return bars.join(cut(index, "index"), "date", "left")


def relative_strength(bars: DataFrame, n: int = 20) -> DataFrame:
    own = F.col("close") / F.nullif(lag("close", n), F.lit(0.0)) - 1.0
    return bars.withColumn("return_20d", own).withColumn("rel_strength_20d", F.col("return_20d") - F.col("mkt_return_20d"))


def beta(bars: DataFrame, n: int = 60) -> DataFrame:
    """Covariance of own and market returns by the market's variance over the last n rows, which must have both.

    A window is the end of one block of n rows and the beginning of the next, so a row adds to two running moments instead of
    n rows to its own, and merged moments are as good as those of the window itself."""
    df = bars.withColumns({"__x": F.ln("close") - lag(F.ln("close")), "__i": F.row_number().over(by_symbol()) - 1})
    both = F.col("__x").isNotNull() & F.col("mkt_log_return").isNotNull()
    df = df.withColumns({"__x": F.when(both, F.col("__x")), "__y": F.when(both, F.col("mkt_log_return")), "__b": F.floor(F.col("__i") / n), "__k": F.col("__i") % n})
    block, rows = Window.partitionBy("symbol", "__b"), Window.partitionBy("symbol").orderBy("__b", "date")
    kinds = {"n": F.count("__x"), "x": F.avg("__x"), "y": F.avg("__y"), "c": F.covar_pop("__x", "__y"), "v": F.var_pop("__y"), "lo": F.min("__y"), "hi": F.max("__y")}
    run = lambda side, order: {f"__{side}_{k}": f.over(block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) for k, f in kinds.items()}
    df = df.withColumns(run("end", F.col("date").desc())).withColumns(run("own", F.col("date").asc()))
    df = df.withColumns({f"__end_{k}": F.when(F.col("__k") < n - 1, F.lag(f"__end_{k}", n - 1).over(rows)) for k in kinds})
    a, b = (lambda k: F.col(f"__end_{k}")), (lambda k: F.col(f"__own_{k}"))
    size, whole = F.col("__k") + 1, F.coalesce(a("n"), F.lit(0)) + b("n") == n
    merged = lambda k, x, y: F.when(F.col("__k") == n - 1, b(k) * n).otherwise(a(k) * (n - size) + b(k) * size + (a(x) - b(x)) * (a(y) - b(y)) * size * (n - size) / n)
    varies = F.least(a("lo"), b("lo")) < F.greatest(a("hi"), b("hi"))
    df = df.withColumn(f"beta_{n}d", F.when(whole & varies, merged("c", "x", "y") / F.nullif(merged("v", "y", "y"), F.lit(0.0))))
    return df.drop("__x", "__y", "__i", "__b", "__k", *[f"__{s}_{k}" for s in ("end", "own") for k in kinds])


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({"day_of_week": F.weekday(date), "day_of_month": F.dayofmonth(date), "days_to_month_end": F.datediff(F.last_day(date), F.col(date))})


def pct_rank(df: DataFrame, col: str, by: str, out: str | None = None) -> DataFrame:
    """Average rank by share of the non-null values; null stays null. A group is one window, as the symbols of a day are; large_rank() has no such bound."""
    group = Window.partitionBy(by)
    rank = F.rank().over(group.orderBy(F.col(col).asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(by, col))
    value = (rank + (ties - 1) / 2.0) / F.count(col).over(group)
    return df.withColumn(out or f"{col}_rank", F.when(F.col(col).isNotNull(), value))


def large_rank(df: DataFrame, col: str, by: str, out: str | None = None) -> DataFrame:
    """pct_rank() for groups of any size: ranks of the distinct values, made by ranges, are joined back to the rows. Rows without
    group are one group, as there."""
    kind = df.schema[by].dataType
    filled = F.coalesce(F.col(by), F.lit("") if kind.typeName() == "string" else F.lit("0").cast(kind))
    rows = df.withColumns({"__by": filled, "__blank": F.col(by).isNull(), "__value": F.col(col)})
    keys = ["__by", "__blank"]
    ranks = tie_ranks(rows.select(*keys, "__value"), keys, "__value").select(*keys, "__value", (F.col("average") / F.col("total")).alias("__rank"))
    ranks = cut(ranks, "ranks")
    return join_keyed(rows, ranks, [*keys, "__value"], "left").withColumn(out or f"{col}_rank", F.col("__rank")).drop(*keys, "__value", "__rank")


def trailing_stats(bars: DataFrame, n: int = 20) -> DataFrame:
    """Last finite close, mean of the last n finite volumes, and median relative range of the last n valid bars, held to .005-.05.

    A bar is valid with high, low and a positive close, and high no less than low; others take no place among the n."""
    df = bars.withColumns({
        "__range": F.when((F.col("close") > 0) & (F.col("high") >= F.col("low")), (F.col("high") - F.col("low")) / F.col("close")),
        "__volume": F.when(~F.isnan("volume") & (F.abs("volume") < float("inf")), F.col("volume").cast("double")),
    })
    df = df.withColumns({"__r": F.col("__range").isNotNull(), "__v": F.col("__volume").isNotNull()})
    # Rows with a value are a sequence of their own; the others take the last one's result.
    own = lambda flag: Window.partitionBy("symbol", flag).orderBy("date").rowsBetween(-(n - 1), 0)
    df = df.withColumns({"__median": F.when(F.col("__r"), F.percentile("__range", 0.5).over(own("__r"))), "__mean": F.when(F.col("__v"), F.avg("__volume").over(own("__v")))})
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    return df.withColumns({
        "last_close": last(F.when(~F.isnan("close") & (F.abs("close") < float("inf")), F.col("close"))), "mean_volume": last("__mean"),
        "median_range": F.coalesce(F.least(F.greatest(last("__median"), F.lit(0.005)), F.lit(0.05)), F.lit(0.02)),
    }).drop("__range", "__volume", "__r", "__v", "__median", "__mean")
