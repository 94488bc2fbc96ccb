"""Forward labels, lagged features and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.indicators import by_symbol


def forward_labels(bars: DataFrame, horizons: range = range(1, 31)) -> DataFrame:
    """ln(c[t+h] / c[t]) for each horizon h, and whether all are there."""
    df = bars.withColumn("__ln", F.ln("close"))
    names = {f"y_logret_h{h}": F.lead("__ln", h).over(by_symbol()) - F.col("__ln") for h in horizons}
    df = df.withColumns(names).drop("__ln")
    return df.withColumn("has_labels", F.forall(F.array(*names), lambda y: y.isNotNull()))


def target_labels(bars: DataFrame, horizons: range = range(1, 6)) -> DataFrame:
    """ln(c[t+h-1] / c[t-1]): the row is the first day that is forecast; null unless both closes are positive."""
    before = F.lag("close").over(by_symbol())
    later = {h: F.lead("close", h - 1).over(by_symbol()) for h in horizons}
    return bars.withColumns({f"y_logret_h{h}": F.when((before > 0) & (c > 0), F.ln(c / before)) for h, c in later.items()})


def positions(bars: DataFrame) -> DataFrame:
    return bars.withColumn("pos", F.row_number().over(by_symbol()) - 1)


def lag_features(bars: DataFrame, cols: list[str], lags: int = 3, keep: tuple[str, ...] = ("open", "close", "volume")) -> DataFrame:
    """Lags 1..``lags`` of ``cols``; the columns go unless in ``keep``; rows with nulls go."""
    new = {f"{c}_lag{k}": F.lag(c, k).over(by_symbol()) for c in cols for k in range(1, lags + 1)}
    return bars.withColumns(new).drop(*[c for c in cols if c not in keep]).na.drop(subset=list(new))


def next_close_pairs(bars: DataFrame, n: int = 20) -> DataFrame:
    """The close of each row with the ``n`` closes before it, where there are that many."""
    before = F.collect_list("close").over(by_symbol().rowsBetween(-n, -1))
    return bars.withColumn("window", before).where(F.size("window") == n).withColumn("target", F.col("close"))
