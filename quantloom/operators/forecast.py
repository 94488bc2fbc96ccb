"""Post-processing of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weights of the models at hand: negative ones count 0, then shares; equal shares if all are 0."""
    w = Window.partitionBy(*keys)
    held = F.greatest("weight", F.lit(0.0))
    total = F.sum(held).over(w)
    return df.withColumn("weight", F.when(total > 0, held / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.count("*").over(w)))


def ensemble(df: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """The weighted mean of rows (keys, model, pred) with normalize_weights(); the weights are a literal of a few entries. One aggregate, no window."""
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("model")), F.lit(0.0))
    held = F.greatest(own, F.lit(0.0))
    out = df.groupBy(*keys).agg(F.sum(held).alias("__total"), F.sum(held * F.col("pred")).alias("__held"), F.sum("pred").alias("__sum"), F.count("*").alias("__n"))
    return out.select(*keys, F.when(F.col("__total") > 0, F.col("__held") / F.nullif("__total", F.lit(0.0))).otherwise(F.col("__sum") / F.col("__n")).alias("pred"))


def ensemble_columns(df: DataFrame, weights: dict[str, float], out: str = "pred") -> DataFrame:
    """ensemble() of models that are columns, each row on its own: a null is a model that isn't at hand. Nothing is shuffled or sorted."""
    add = lambda f: sum((F.when(F.col(m).isNotNull(), f(m, max(0.0, w))).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
    total, n = add(lambda m, w: F.lit(float(w))), add(lambda m, w: F.lit(1.0))
    held, plain = add(lambda m, w: w * F.col(m)), add(lambda m, w: F.col(m))
    return df.withColumn(out, F.when(total > 0, held / F.nullif(total, F.lit(0.0))).otherwise(plain / F.nullif(n, F.lit(0.0))))


def sort_quantiles(df: DataFrame) -> DataFrame:
    """q10 <= q50 <= q90."""
    q = F.array_sort(F.array("q10", "q50", "q90"))
    return df.withColumn("__q", q).withColumns({"q10": F.col("__q")[0], "q50": F.col("__q")[1], "q90": F.col("__q")[2]}).drop("__q")


def to_price(anchor: Column, log_return: Column, clip: float | None = None) -> Column:
    return anchor * F.exp(F.greatest(F.least(log_return, F.lit(clip)), F.lit(-clip)) if clip is not None else log_return)


def stabilize_path(df: DataFrame, cutoff: int, blend: float, clip: float, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Sums clipped increments of q50 over the horizons; up to ``cutoff`` they replace it, beyond they are blended in."""
    w = Window.partitionBy(*keys).orderBy("horizon")
    step = F.col("q50") - F.coalesce(F.lag("q50").over(w), F.lit(0.0))
    df = df.withColumn("__step", F.greatest(F.least(step, F.lit(clip)), F.lit(-clip)))
    path = F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = min(1.0, max(0.0, blend))
    return df.withColumn("q50_stable", F.when(F.col("horizon") <= max(1, cutoff), path).otherwise((1 - b) * F.col("q50") + b * path)).drop("__step")


def stabilize_columns(q50: dict[int, Column], cutoff: int, blend: float, clip: float) -> dict[int, Column]:
    """stabilize_path() of forecasts that are columns by horizon, each row on its own: nothing is sorted, and no task holds more than its rows."""
    b, before, path, out = min(1.0, max(0.0, blend)), F.lit(0.0), None, {}
    for h, q in sorted(q50.items()):
        step = F.greatest(F.least(q - F.coalesce(before, F.lit(0.0)), F.lit(clip)), F.lit(-clip))
        path = step if path is None else path + step
        out[h], before = path if h <= max(1, cutoff) else (1 - b) * q + b * path, q
    return out


def high_low(open_: Column, close: Column, rng: Column) -> tuple[Column, Column]:
    """A high and low around a projected bar: margins of half the usual range or a quarter of the body, within 8 percent."""
    margin = F.greatest(F.greatest(F.abs(open_), F.abs(close), F.lit(1.0)) * rng * 0.5, F.abs(open_ - close) * 0.25)
    up, down = F.greatest(open_, close), F.least(open_, close)
    high, low = F.least(up + margin, up * 1.08), F.greatest(down - margin, down * 0.92, F.lit(0.01))
    return F.when(low > high, up).otherwise(high), F.when(low > high, F.greatest(down, F.lit(0.01))).otherwise(low)


def next_business_day(date: Column) -> Column:
    """The next day, or Monday from Friday and Saturday on."""
    return F.date_add(date, F.when(F.weekday(date) == 4, 3).when(F.weekday(date) == 5, 2).otherwise(1))


def next_bar(stats: DataFrame, log_return: Column) -> DataFrame:
    """The bar after each symbol's last one: open at its close, close by the return, C5 ranges, mean volume.
    ``stats`` has the columns of trailing_stats()."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    last = stats.withColumn("__k", F.row_number().over(w)).where("__k = 1").withColumn("__close", to_price(F.col("last_close"), log_return, 0.08))
    high, low = high_low(F.col("last_close"), F.col("__close"), F.col("median_range"))
    return last.select("symbol", next_business_day(F.col("date")).alias("date"), F.col("last_close").alias("open"), high.alias("high"), low.alias("low"), F.col("__close").alias("close"), F.col("mean_volume").alias("volume"))


def errors(df: DataFrame, y: str, yhat: str) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    return df.withColumns({"abs_error": F.abs(e), "sq_error": e * e, "pct_error": F.abs(e / F.nullif(F.col(y), F.lit(0.0))) * 100})


def to_wide(df: DataFrame, keys: list[str], value: str, days: int = 5) -> DataFrame:
    """One column per horizon, of rows unique by (keys, horizon); one aggregate by the keys, where a pivot has another by horizon below it, with a table of all rows."""
    days = days if days > 0 else 5
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("horizon") == h, F.col(value))).alias(f"forecast_close_t{h}") for h in range(1, days + 1)])


def backtest_table(bars: DataFrame, pred: DataFrame, split_end: str, horizons: int = 5) -> DataFrame:
    """Forecasts (symbol, date, horizon, q50) with anchor and realised closes: a row a (symbol, date, horizon) with predicted and
    realised return and price, the day of the outcome, and whether that is within the split. Outcomes not yet known are null."""
    w = Window.partitionBy("symbol").orderBy("date")
    outcome = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("date", h).over(w).alias("realised_date"), F.lead("close", h).over(w).alias("realised_price")) for h in range(1, horizons + 1)])
    wide = bars.select("symbol", "date", F.col("close").alias("anchor"), outcome.alias("outcomes"))
    # Both sides are grouped by (symbol, date) as one table, so that where both are dealt by symbol no row is shuffled again; a join would deal five rows a bar of each by all its keys.
    bar, forecast = F.struct("anchor", "outcomes"), F.struct("horizon", "q50")
    both = wide.select("symbol", "date", bar.alias("bar")).unionByName(pred.select("symbol", "date", forecast.alias("forecast")), allowMissingColumns=True)
    met = both.where("symbol is not null and date is not null").groupBy("symbol", "date").agg(F.collect_list("bar").alias("bar"), F.collect_list("forecast").alias("forecast"))
    met = met.withColumn("bar", F.explode("bar")).withColumn("forecast", F.explode("forecast")).select("symbol", "date", "forecast.horizon", "bar.anchor", "bar.outcomes", "forecast.q50").where(F.col("horizon").between(1, horizons))
    out = met.withColumn("o", F.element_at("outcomes", F.col("horizon").cast("int"))).select("symbol", "date", "horizon", "anchor", "o.realised_date", "o.realised_price", "q50")
    return out.withColumns({
        "predicted_price": to_price(F.col("anchor"), F.col("q50")), "realised_return": F.ln(F.col("realised_price") / F.nullif(F.col("anchor"), F.lit(0.0))),
        "in_split": F.coalesce(F.col("realised_date") <= F.to_date(F.lit(split_end)), F.lit(False)),
    })


def join_actuals(pred: DataFrame, bars: DataFrame, start: str, end: str) -> DataFrame:
    """Forecast prices next to the closes of their day, within a range of days."""
    days = F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return pred.join(bars.select("symbol", "date", F.col("close").alias("actual")), ["symbol", "date"]).where(days)
