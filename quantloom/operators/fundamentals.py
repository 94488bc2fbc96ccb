"""Quarterly statements: ratios, growth and ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import quarter_label, ratio, truthy, yoy
from quantloom.operators.regime import large_rank


def quarter_financials(df: DataFrame) -> DataFrame:
    """Ratios of each (ticker, quarter_end) statement; nulls and zero denominators give null; of two names for
    net income the second counts where the first is 0."""
    income = truthy(F.col("net_income"), F.col("net_income_common"))
    return df.withColumns({
        "quarter": quarter_label(F.col("quarter_end")), "net_margin": ratio(income, F.col("revenue")), "debt_to_equity": ratio(F.col("debt"), F.col("equity")),
        "roe": ratio(income, F.col("equity")), "asset_turnover": ratio(F.col("revenue"), F.col("assets")), "free_cash_flow": F.col("op_cashflow") + F.col("capex"),
    })


def growth(df: DataFrame) -> DataFrame:
    """Year over year against four quarters back."""
    w = Window.partitionBy("ticker").orderBy("quarter_end")
    return df.withColumns({"revenue_yoy": yoy(F.col("revenue"), F.lag("revenue", 4).over(w)), "income_yoy": yoy(F.col("net_income"), F.lag("net_income", 4).over(w))})


def last_quarters(df: DataFrame, n: int = 4) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.col("quarter_end").desc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_source(frames: list[DataFrame], n: int = 4) -> DataFrame:
    """The last ``n`` quarters (ticker, quarter_end, rank, source) that the statement with the most usable dates of a ticker has; the first of equal ones."""
    tagged = [f.select("ticker", "quarter_end", F.lit(k).alias("source")) for k, f in enumerate(frames)]
    dates = reduce(DataFrame.unionByName, tagged).where(F.col("quarter_end").isNotNull()).distinct()
    counts = dates.groupBy("ticker", "source").agg(F.count("*").alias("__n"))
    best = counts.groupBy("ticker").agg(F.max_by("source", F.struct("__n", -F.col("source"))).alias("source"))
    return last_quarters(dates.join(best, ["ticker", "source"]), n)


def flat_fundamentals(quarters: DataFrame, info: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """One row a ticker from its newest quarter: growth over four quarters back, margins, and the market's own figures.

    ``info`` (ticker, sector, market_cap, pe_trailing, pe_forward, pb, return_on_equity, debt_to_equity in percent)
    goes before the ratios of the statements where it has a value; the cash flow yield is by market_cap."""
    rows = growth(quarter_financials(quarters))
    rows = last_quarters(rows, 1).drop("rank").withColumnsRenamed({"roe": "__roe", "debt_to_equity": "__de"})
    out = rows.join(info.withColumnRenamed("debt_to_equity", "__percent"), "ticker", "left").join(next_event(events, as_of), "ticker", "left")
    return out.select(
        "ticker", as_of.alias("as_of_date"), "sector", F.col("revenue").alias("revenue_ttm_proxy"), "revenue_yoy", F.col("income_yoy").alias("net_income_yoy"), ratio(F.col("operating_income"), F.col("revenue")).alias("operating_margin"), "net_margin",
        F.coalesce("return_on_equity", "__roe").alias("roe"), F.coalesce(F.col("__percent") / 100.0, F.col("__de")).alias("debt_to_equity"), "asset_turnover", ratio(F.col("free_cash_flow"), F.col("market_cap")).alias("fcf_yield"),
        "pe_trailing", "pe_forward", "pb", "market_cap", F.col("next_date").alias("next_earnings_date"), F.col("days_to").alias("days_to_earnings"), F.coalesce("in_window", F.lit(0)).alias("in_earnings_window_5d"),
    )


def next_event(events: DataFrame, as_of: Column) -> DataFrame:
    """The first event after a day, the days to it, and whether it is at most five away."""
    out = events.groupBy("ticker").agg(F.min(F.when(F.col("event_date") > as_of, F.col("event_date"))).alias("next_date"))
    days = F.datediff("next_date", as_of)
    return out.withColumns({"days_to": days, "in_window": F.coalesce(days.between(0, 5), F.lit(False)).cast("int")})


def attach_fundamentals(bars: DataFrame, flat: DataFrame) -> DataFrame:
    """One row a ticker, so Spark broadcasts it while it is small."""
    return bars.join(flat, bars["symbol"] == flat["ticker"], "left").drop("ticker")


def sector_rank(df: DataFrame, col: str = "pe") -> DataFrame:
    """Average rank within the sector by share of its non-null values."""
    return large_rank(df, col, "sector", f"{col}_sector_rank")


def encode_financials(df: DataFrame, cols: list[str]) -> DataFrame:
    """The statement's items as one JSON text, for tables whose items vary."""
    return df.withColumn("financials", F.to_json(F.struct(*cols))).drop(*cols)


def decode_financials(df: DataFrame, cols: list[str]) -> DataFrame:
    """Doubles from the JSON text; absent or invalid text gives nulls."""
    kind = "struct<" + ",".join(f"{c}:double" for c in cols) + ">"
    return df.withColumn("__f", F.from_json("financials", kind)).select(*df.columns, *[F.col(f"__f.{c}").alias(c) for c in cols]).drop("financials")
