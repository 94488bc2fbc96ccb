"""Evaluation of forecasts: errors, quantile losses, rank correlation, lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.tables import cut, median, parts_of, ranked
from quantloom.operators.regime import pct_rank


def regression_metrics(df: DataFrame, y: str, yhat: str, by: str | None = None, p: int = 580) -> DataFrame:
    """n, mse, rmse, mae, r2, adjusted_r2, mape; overall (``by`` null) and for each value of ``by``.

    r2 needs two rows and two values; adjusted_r2 more than p + 1 rows; mape leaves out y = 0."""
    rows = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).withColumn("__e", F.col(y) - F.col(yhat))
    grouped = rows.rollup(by) if by else rows.groupBy()
    out = grouped.agg(
        F.count("*").alias("n"), F.avg(F.col("__e") * F.col("__e")).alias("mse"), F.avg(F.abs("__e")).alias("mae"), F.var_pop(y).alias("__var"),
        F.min(y).alias("__lo"), F.max(y).alias("__hi"), (F.avg(F.abs(F.col("__e") / F.nullif(F.col(y), F.lit(0.0)))) * 100).alias("mape"),
    )
    out = out.withColumn("r2", F.when((F.col("n") > 1) & (F.col("__lo") < F.col("__hi")), 1 - F.col("mse") / F.nullif(F.col("__var"), F.lit(0.0))))
    adjusted = F.when(F.col("n") > p + 1, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / F.nullif(F.col("n") - p - 1, F.lit(0)))
    return out.withColumns({"rmse": F.sqrt("mse"), "adjusted_r2": adjusted}).drop("__var", "__lo", "__hi")


def horizon_metrics(df: DataFrame, y: str = "y", yhat: str = "q50") -> DataFrame:
    """rmse, mae and share of equal signs by horizon and overall."""
    e = F.col(y) - F.col(yhat)
    return df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).rollup("horizon").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg((F.signum(y) == F.signum(yhat)).cast("double")).alias("directional_accuracy")
    )


def pinball_loss(y: Column, quantiles: dict[float, Column]) -> Column:
    """The mean over quantiles of max(q d, (q - 1) d), d = y - prediction."""
    return sum((F.greatest(q * (y - p), (q - 1) * (y - p)) for q, p in quantiles.items()), F.lit(0.0)) / len(quantiles)


def rank_ic(df: DataFrame, y: str, p: str, by: str, keys: list[str]) -> DataFrame:
    """Mean Spearman correlation of groups with two rows and no constant side, and their number, by ``keys``."""
    each = _correlations(df.where(F.col(y).isNotNull() & F.col(p).isNotNull()), y, p, by, keys)
    return each.where(_VARIED).groupBy(*keys).agg(F.avg("ic").alias("spearman_ic"), F.count("*").alias("spearman_groups"))


def _correlations(rows: DataFrame, y: str, p: str, by: str, keys: list[str], *more: Column) -> DataFrame:
    """A row a group: n, the correlation ic of its ranks, their spreads a and b, and ``more`` aggregates."""
    rows = rows.withColumn("__g", F.struct(*keys, by))
    rows = pct_rank(pct_rank(rows, y, "__g", "__ry"), p, "__g", "__rp")
    return rows.groupBy("__g").agg(F.count("*").alias("n"), F.corr("__ry", "__rp").alias("ic"), F.stddev_pop("__ry").alias("a"), F.stddev_pop("__rp").alias("b"), *more).select("__g.*", "*").drop("__g")


_VARIED = "n >= 2 and a > 1e-12 and b > 1e-12"


def forecast_metrics(df: DataFrame) -> DataFrame:
    """By horizon, over rows with an outcome: n, pinball, mae_q50, coverage of q10..q90, rank correlation per date and its groups. All are summed with the
    correlations of a date, so ``df`` is read once."""
    rows = df.where("y is not null and q50 is not null")
    loss = pinball_loss(F.col("y"), {0.1: F.col("q10"), 0.5: F.col("q50"), 0.9: F.col("q90")})
    rows = rows.select("horizon", "date", "y", "q50", loss.alias("__loss"), F.abs(F.col("y") - F.col("q50")).alias("__error"), F.col("y").between(F.col("q10"), F.col("q90")).cast("double").alias("__in"))
    means = {"pinball": "__loss", "mae_q50": "__error", "coverage_q10_q90": "__in"}
    each = _correlations(rows, "y", "q50", "date", ["horizon"], *[f(c).alias(f"{c}_{k}") for c in means.values() for k, f in (("sum", F.sum), ("n", F.count))])
    ic = F.when(F.expr(_VARIED), F.col("ic"))
    return each.groupBy("horizon").agg(F.sum("n").alias("n"), *[(F.sum(f"{c}_sum") / F.nullif(F.sum(f"{c}_n"), F.lit(0))).alias(m) for m, c in means.items()], F.avg(ic).alias("spearman_ic"), F.count_if(F.expr(_VARIED)).alias("spearman_groups"))


def quality_summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("pinball").alias("pinball"), F.avg("coverage_q10_q90").alias("coverage_q10_q90"), F.avg("spearman_ic").alias("spearman_ic"))


def decile_lift(df: DataFrame, order: list[str], beside: float = 0.001, accuracy: int = 2000) -> DataFrame:
    """Means of the outcome in the top and bottom tenth by q50, ties in ``order``; null under 10 rows.

    A rank r of n is in tenth ceil((r - 1) * 10 / (n - 1)) - 1, which is where equal-width
    quantile edges over 1..n put it. Approximate percentiles ``beside`` the two edges bound them: rows between are counted and summed by q50 and the
    first of ``order``, all others by the three zones outside, and these few groups are ranked. Rows are only ranked where an edge is within
    their group, as where many share its q50, or where it isn't between the percentiles. Both readings of ``df`` are in one plan, so
    that what it shuffles is shuffled once, and once more if rows are ranked. A row a horizon is broadcast, and a group an edge."""
    rows = df.where("y is not null and q50 is not null").select("horizon", "q50", "y", *order)
    bounds = F.percentile_approx(F.nanvl("q50", F.lit(float("inf"))), [0.1 - beside, 0.1 + beside, 0.9 - beside, 0.9 + beside], accuracy)
    x, at, near, first = F.col("q50"), [F.col("__bounds")[k] for k in range(4)], F.col("__zone").isin(1, 3), order[:1]
    zone = F.when(x < at[0], 0).when(x <= at[1], 1).when(x < at[2], 2).when(x <= at[3], 3).otherwise(4)
    zoned = rows.join(F.broadcast(rows.groupBy("horizon").agg(bounds.alias("__bounds"))), "horizon").withColumn("__zone", zone)
    groups = zoned.groupBy("horizon", "__zone", F.when(near, x).alias("__q50"), *[F.when(near, F.col(c)).alias(c) for c in first])
    groups = groups.agg(F.min("q50").alias("__lo"), F.max("q50").alias("__hi"), F.count("*").alias("__n"), F.sum("y").alias("__sum")).drop("__q50")
    groups = ranked(groups, ["horizon"], ["__zone", "__lo", *first], "__n")
    enough, low, high = F.col("total") >= 10, F.expr("(total - 1) div 10 + 1"), F.expr("(total - 1) * 9 div 10 + 1")  # ranks below low are in the bottom tenth, from high on in the top one
    mixed = enough & ((F.col("rank") < low) & (low < F.col("rank") + F.col("__n")) | (F.col("rank") < high) & (high < F.col("rank") + F.col("__n")))
    kept = ["horizon", "rank", "total", "__n", "__sum"]
    if not groups.where(mixed).isEmpty():
        edges = groups.where(mixed).select(*[F.col(c).alias(f"__{c}") for c in ("horizon", "rank", "total", *first)], "__zone", "__lo", "__hi")
        own = [~near | F.col(c).eqNullSafe(F.col(f"__{c}")) for c in first]
        inside = rows.join(F.broadcast(edges), [F.col("horizon") == F.col("__horizon"), x.between(F.col("__lo"), F.col("__hi")), *own])
        single = ranked(inside.select("horizon", "__rank", "__total", "q50", "y", *order), ["horizon", "__rank"], ["q50", *order, "y"])
        single = single.select("horizon", (F.col("__rank") + F.col("rank")).alias("rank"), F.col("__total").alias("total"), F.lit(1).alias("__n"), F.col("y").alias("__sum"))
        groups = groups.where(~mixed).select(*kept).unionByName(single)
    mean = lambda those: F.sum(F.when(enough & those, F.col("__sum"))) / F.nullif(F.sum(F.when(enough & those, F.col("__n"))), F.lit(0))
    out = groups.groupBy("horizon").agg(F.sum("__n").alias("n"), mean(F.col("rank") >= high).alias("top_decile_mean"), mean(F.col("rank") < low).alias("bottom_decile_mean"), mean(F.lit(True)).alias("overall_mean"))
    return out.withColumns({"top_vs_overall": F.col("top_decile_mean") - F.col("overall_mean"), "top_vs_bottom": F.col("top_decile_mean") - F.col("bottom_decile_mean")})


def validation_score(df: DataFrame, tilt: float = 1.0, horizons: int = 5, by_volatility: bool = False, windows: int = 0, least: int = 1) -> DataFrame:
    """Horizon-weighted rmse and mae, directional accuracy, a normaliser, and the score 0.4 rmse + 0.3 mae (normalised) - 0.3 accuracy:
    a row with window null over all, and one for each of ``windows`` equal runs of (symbol, date) rows in order of their dates.

    Weights go evenly from 1 to max(0.2, tilt), with mean 1. The normaliser, the same for all rows, is the median absolute outcome or,
    ``by_volatility``, the median over (symbol, date) of the spread of their absolute outcomes over the horizons; 1e-4 at
    least. Fewer than ``least`` outcomes are an error. Rows are written once; medians come from counts and windows from the first
    (date, symbol) of each, so rows aren't shuffled for either."""
    top = max(0.2, tilt)
    raw = [1.0 + (top - 1.0) * k / max(1, horizons - 1) for k in range(horizons)]
    mean = sum(raw) / horizons
    weight = F.element_at(F.array(*[F.lit(x / mean) for x in raw]), F.col("horizon").cast("int"))
    e = F.col("y") - F.col("q50")
    df = cut(df.select("symbol", "date", "horizon", "y", "q50"), "scored")
    rows = df.where("y is not null and q50 is not null")
    if least > 1 and (n := rows.count()) < least:
        raise ValueError(f"too few validation points: {n}")
    if by_volatility or windows:
        spread = F.stddev_pop(F.when(F.col("q50").isNotNull(), F.abs("y"))) if by_volatility else F.lit(None).cast("double")
        points = cut(df.repartition(parts_of(df, 1 << 20), "symbol").groupBy("symbol", "date").agg(spread.alias("v")), "points")
    usual = median(points if by_volatility else rows.select(F.abs("y").alias("v")), "v")
    rows = rows.withColumn("window", F.lit(None).cast("int"))
    if windows:
        days = ranked(points.select("symbol", "date"), [], ["date", "symbol"])
        # The first total % windows runs have one row more.
        each, more = F.floor(F.col("total") / windows), F.col("total") % windows
        at = F.when(F.col("rank") < more * (each + 1), F.floor(F.col("rank") / (each + 1))).otherwise(more + F.floor((F.col("rank") - more * (each + 1)) / F.greatest(each, F.lit(1))))
        starts = days.groupBy(at.alias("at")).agg(F.min(F.struct("date", "symbol")).alias("first")).collect()  # a row a window
        kinds = {c: df.schema[c].dataType for c in ("date", "symbol")}
        own = F.struct("date", "symbol")
        begun = [own >= F.struct(*[F.lit(r["first"][c]).cast(kinds[c]).alias(c) for c in kinds]) for r in starts]
        rows = rows.withColumn("window", sum((b.cast("int") for b in begun), F.lit(0)))
    grouped = rows.rollup("window") if windows else rows.groupBy("window")
    out = grouped.agg(F.sqrt(F.avg(e * e * weight)).alias("rmse"), F.avg(F.abs(e) * weight).alias("mae"), F.avg((F.signum("y") == F.signum("q50")).cast("double")).alias("directional_accuracy"))
    out = out.withColumn("normalizer", F.greatest(usual.scalar(), F.lit(1e-4)))
    return out.withColumn("score", 0.4 * F.col("rmse") / F.col("normalizer") + 0.3 * F.col("mae") / F.col("normalizer") - 0.3 * F.col("directional_accuracy"))


def model_comparison(df: DataFrame, y: str, models: list[str], by: str = "symbol", p: int = 580) -> DataFrame:
    """Regression metrics for each (by, model), from one column a model."""
    long = df.select(by, y, F.explode(F.create_map(*[x for m in models for x in (F.lit(m), F.col(m))])).alias("model", "__p"))
    out = regression_metrics(long.withColumn("__key", F.struct(by, "model")), y, "__p", "__key", p).where("__key is not null")
    return out.select(f"__key.{by}", "__key.model", *[c for c in out.columns if c != "__key"])


def fifo_pnl(trades: DataFrame) -> DataFrame:
    """Realised profit by symbol, sells matched to the oldest buys.

    Each side's cumulative quantities are intervals; the ends of both sides cut the axis into
    segments, each within one buy and one sell, found by the next end of either side. So
    the work is a sort a symbol, not a join of its buys and sells."""
    side = Window.partitionBy("symbol", "side").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("symbol").orderBy(F.col("hi").desc(), "side")
    rows = trades.withColumn("hi", F.sum("qty").over(side))
    above = lambda s: F.last(F.when(F.col("side") == s, F.col("price")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.select("symbol", (F.col("hi") - F.coalesce(F.lead("hi").over(down), F.lit(0.0))).alias("part"), above("buy").alias("buy"), above("sell").alias("sell"))
    matched = parts.where("part > 0 and buy is not null and sell is not null")
    return matched.groupBy("symbol").agg(F.sum("part").alias("qty"), F.sum(F.col("part") * (F.col("sell") - F.col("buy"))).alias("pnl"))
