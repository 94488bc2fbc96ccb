"""Technical indicators over all symbols at once.

Bars have symbol, date, open, high, low, close, volume. Every indicator is a function of
bars and adds columns; all use the windows of one (symbol, date) order, so a stack of
them is planned with one exchange and one sort. Rows without a full window are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_symbol():
    """The window of a symbol's bars in order of their dates."""
    return Window.partitionBy("symbol").orderBy("date")


def trailing(n: int):
    return by_symbol().rowsBetween(-(n - 1), 0)


def full(value: Column, of: Column, n: int) -> Column:
    """``value`` where the last n rows all have ``of``."""
    return F.when(F.count(of).over(trailing(n)) == n, value)


def mean(c: Column, n: int) -> Column:
    return full(F.avg(c).over(trailing(n)), c, n)


def total(c: Column, n: int) -> Column:
    return full(F.sum(c).over(trailing(n)), c, n)


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(by_symbol())


def sma(n: int, c: str = "close") -> Column:
    return mean(F.col(c), n)


def rsi(bars: DataFrame, n: int = 14, out: str | None = None) -> DataFrame:
    """Simple means of gains and losses; the first difference counts as 0; null without losses."""
    d = F.col("close") - lag("close")
    df = bars.withColumn("__gain", F.when(d > 0, d).otherwise(0.0)).withColumn("__loss", F.when(d < 0, -d).otherwise(0.0))
    gain, loss = mean(F.col("__gain"), n), mean(F.col("__loss"), n)
    return df.withColumn(out or f"rsi_{n}", 100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0)))).drop("__gain", "__loss")


def stochastic(bars: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    lo, hi = full(F.min("low").over(trailing(k)), F.col("low"), k), full(F.max("high").over(trailing(k)), F.col("high"), k)
    df = bars.withColumn("stoch_k", 100.0 * (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return df.withColumn("stoch_d", mean(F.col("stoch_k"), d))


def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return bars.withColumn("__tr", true_range()).withColumn(f"atr_{n}", mean(F.col("__tr"), n)).drop("__tr")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    up, down = F.col("high") - lag("high"), lag("low") - F.col("low")
    df = bars.withColumns({
        "__plus": F.when((up > 0) & (up > F.greatest(down, F.lit(0.0))), up).otherwise(0.0),
        "__minus": F.when((down > 0) & (down > F.greatest(up, F.lit(0.0))), down).otherwise(0.0),
        "__tr": true_range(),
    })
    tr = F.nullif(total(F.col("__tr"), n), F.lit(0.0))
    df = df.withColumns({"__pdi": 100.0 * total(F.col("__plus"), n) / tr, "__mdi": 100.0 * total(F.col("__minus"), n) / tr})
    df = df.withColumn("__dx", 100.0 * F.abs(F.col("__pdi") - F.col("__mdi")) / F.nullif(F.abs(F.col("__pdi") + F.col("__mdi")), F.lit(0.0)))
    return df.withColumn(f"adx_{n}", mean(F.col("__dx"), n)).drop("__plus", "__minus", "__tr", "__pdi", "__mdi", "__dx")


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    mid, std = sma(n), full(F.stddev_samp("close").over(trailing(n)), F.col("close"), n)
    return bars.withColumns({"bb_upper": mid + width * std, "bb_middle": mid, "bb_lower": mid - width * std})


def obv(bars: DataFrame) -> DataFrame:
    signed = F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)) * F.col("volume")
    return bars.withColumn("__signed", signed).withColumn("obv", F.sum("__signed").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).drop("__signed")


def vwap(bars: DataFrame) -> DataFrame:
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    return bars.withColumn("vwap", F.sum(typical * F.col("volume")).over(upto) / F.nullif(F.sum("volume").over(upto), F.lit(0.0)))


def returns(bars: DataFrame) -> DataFrame:
    prev = F.nullif(lag("close"), F.lit(0.0))
    return bars.withColumns({"daily_return_pct": (F.col("close") / prev - 1.0) * 100.0, "log_return_pct": F.ln(F.col("close") / prev) * 100.0})


def roc(bars: DataFrame, n: int = 12) -> DataFrame:
    return bars.withColumn(f"roc_{n}", (F.col("close") - lag("close", n)) / F.nullif(lag("close", n), F.lit(0.0)) * 100.0)


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """The mean absolute deviation is around each window's own mean, over an array of the window."""
    df = bars.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    df = df.withColumns({"__mean": mean(F.col("__tp"), n), "__rows": F.collect_list("__tp").over(trailing(n))})
    mad = F.aggregate("__rows", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("__mean"))) / n
    return df.withColumn(f"cci_{n}", (F.col("__tp") - F.col("__mean")) / F.nullif(0.015 * mad, F.lit(0.0))).drop("__tp", "__mean", "__rows")


def williams_r(bars: DataFrame, n: int = 14) -> DataFrame:
    hh, ll = full(F.max("high").over(trailing(n)), F.col("high"), n), full(F.min("low").over(trailing(n)), F.col("low"), n)
    return bars.withColumn(f"williams_r_{n}", -100.0 * (hh - F.col("close")) / F.nullif(hh - ll, F.lit(0.0)))


class Ema:
    """Exponential means of columns of bars, y0 = x0, y = a x + (1 - a) y', a = 2 / (span + 1), without a sequential pass.

    A linear recurrence scans in two levels: each block of rows sums its inputs with
    their decay; ends of blocks are carried into later ones by a few lags, as the decay over
    whole blocks soon is below the precision of a double. Positions and blocks are made once for all
    spans, and all windows share the order (symbol, block, date). Columns must have no nulls."""

    def __init__(self, bars: DataFrame, block: int = 128) -> None:
        self.block = block
        pos = F.row_number().over(by_symbol()) - 1
        df = bars.withColumn("__pos", pos)
        self.df = df.withColumns({"__block": F.floor(F.col("__pos") / block), "__k": F.col("__pos") % block})
        self.rows = Window.partitionBy("symbol").orderBy("__block", "date")

    def add(self, col: str, spans: dict[str, int]) -> Ema:
        """Adds the means of ``col`` under the names of ``spans``."""
        inner = Window.partitionBy("symbol", "__block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        before = self.rows.rowsBetween(Window.unboundedPreceding, -1)
        k, n = F.col("__k"), self.block
        decay = {out: 1.0 - 2.0 / (span + 1) for out, span in spans.items()}
        first = F.col("__pos") == 0
        own = {f"__own_{out}": F.sum(F.when(first, F.col(col)).otherwise((1.0 - r) * F.col(col)) * F.pow(F.lit(r), -k)).over(inner) * F.pow(F.lit(r), k) for out, r in decay.items()}
        df = self.df.withColumns(own)
        ends = {}
        for out, r in decay.items():
            lags = max(1, math.ceil(math.log(1e-18) / (n * math.log(r)))) if r > 0 else 1
            ends[f"__end_{out}"] = F.when(k == n - 1, sum((F.coalesce(F.lag(f"__own_{out}", n * j).over(self.rows), F.lit(0.0)) * r ** (n * j) for j in range(1, lags)), F.col(f"__own_{out}")))
        df = df.withColumns(ends)
        carried = lambda out: F.coalesce(F.last(f"__end_{out}", ignorenulls=True).over(before), F.lit(0.0))
        self.df = df.withColumns({out: F.col(f"__own_{out}") + F.pow(F.lit(r), k + 1) * carried(out) for out, r in decay.items()}).drop(*own, *ends)
        return self

    def done(self) -> DataFrame:
        return self.df.drop("__pos", "__block", "__k")


def ema(df: DataFrame, col: str, span: int, out: str, block: int = 128) -> DataFrame:
    return Ema(df, block).add(col, {out: span}).done()


def _macd(e: Ema, fast: str, slow: str, signal: int = 9) -> Ema:
    """Adds macd, its signal and their difference from two means at hand."""
    e.df = e.df.withColumn("macd", F.col(fast) - F.col(slow))
    e.add("macd", {"macd_signal": signal})
    e.df = e.df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return e


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return _macd(Ema(bars).add("close", {"__fast": fast, "__slow": slow}), "__fast", "__slow", signal).done().drop("__fast", "__slow")


def spans(df: DataFrame, wanted: dict[str, tuple[str, int, str]]) -> DataFrame:
    """Adds to ``df`` for each (column, n, kind) of ``wanted`` the sum, least, greatest or square (squared deviations from the mean) of the last n rows, null unless all of them
    have a value.

    Spans of 1, 2, 4, ... rows are made of two half as long each, and n rows of the spans that its binary digits name, so a row costs some 2 log n lags where a
    frame costs n updates. Only sums are added up, never taken off, so nothing cancels. All spans of one length share a window operator."""
    name = lambda kind, w, c: f"__{kind}_{w}_{c}"
    parts = {c: {("sum" if k == "square" else k) for d, _, k in wanted.values() if d == c} | {k for d, _, k in wanted.values() if d == c} for c, _, _ in wanted.values()}
    most = {(c, k): max(n for d, n, kind in wanted.values() if d == c and k in (kind, "sum")) for c, kinds in parts.items() for k in kinds}
    start = {"sum": lambda c: F.col(c).cast("double"), "square": lambda c: F.when(F.col(c).isNotNull(), 0.0), "least": F.col, "greatest": F.col}
    df, made, w = df.withColumns({name(k, 1, c): start[k](c) for c, k in most}), [name(k, 1, c) for c, k in most], 1

    def joined(kind: str, a: tuple[str | None, str], na: int, b: tuple[str | None, str], nb: int, back: int) -> Column:
        """The value of a span of na rows (its sum's column and its own) and of one of nb rows that ends ``back`` rows earlier."""
        x, y = F.col(a[1]), lag(b[1], back)
        if kind == "sum":
            return x + y
        if kind == "square":
            d = F.col(a[0]) * float(nb) - lag(b[0], back) * float(na)
            return x + y + d * d / float(na * nb * (na + nb))
        return F.when(x.isNotNull() & y.isNotNull(), getattr(F, kind)(x, y))

    while w <= max(most.values()):
        new, held = {}, lambda kind, c: (name("sum", w, c), name(kind, w, c))
        for (c, k), n in most.items():
            if n >= 2 * w:
                new[name(k, 2 * w, c)] = joined(k, held(k, c), w, held(k, c), w, w)
        for out, (c, n, kind) in wanted.items():
            if kind in ("least", "greatest"):  # two spans that may overlap
                if w <= n < 2 * w:
                    new[out] = joined(kind, held(kind, c), w, held(kind, c), w, n - w) if n > w else F.col(name(kind, w, c))
            elif n & w:
                done = n & (w - 1)
                for k, to in {kind: out, "sum": f"__sum_{out}"}.items() if kind == "square" else ((kind, out),):
                    new[to] = joined(k, (f"__sum_{out}", to), done, held(k, c), w, done) if done else F.col(name(k, w, c))
        df, made, w = df.withColumns(new), made + [c for c in new if c not in wanted], 2 * w
    return df.drop(*made)


def indicators(bars: DataFrame, shift: int = 1) -> DataFrame:
    """The whole table of indicators, lagged ``shift`` bars so that a row knows only earlier ones; bars as they are. All
    that needs rows by (symbol, date) comes first, the exponential means after it, so there are one exchange and two sorts.

    It has what the functions above have one by one, but windows that don't need each other are made together and sums over windows by spans()."""
    close, high, low, zero = F.col("close"), F.col("high"), F.col("low"), F.lit(0.0)
    d, up, down = close - lag("close"), high - lag("high"), lag("low") - low
    df = returns(bars).withColumns({
        "__tp": (high + low + close) / 3.0, "__signed": F.coalesce(F.signum(d), zero) * F.col("volume"), "__tr": true_range(), "__back": lag("close", 12),
        "__gain": F.when(d > 0, d).otherwise(0.0), "__loss": F.when(d < 0, -d).otherwise(0.0),
        "__plus": F.when((up > 0) & (up > F.greatest(down, zero)), up).otherwise(0.0), "__minus": F.when((down > 0) & (down > F.greatest(up, zero)), down).otherwise(0.0),
    })
    df = spans(df, {
        **{f"__close_{n}": ("close", n, "sum") for n in (5, 20, 50)}, "__squares": ("close", 20, "square"), "__typical": ("__tp", 20, "sum"),
        **{f"{c}_14": (c, 14, "sum") for c in ("__gain", "__loss", "__plus", "__minus", "__tr")}, "__low": ("low", 14, "least"), "__high": ("high", 14, "greatest"),
    })
    col, ratio = F.col, lambda x, y: x / F.nullif(y, zero)
    width, tr = F.col("__high") - F.col("__low"), F.nullif(F.col("__tr_14"), zero)
    df = df.withColumns({
        "stoch_k": ratio(100.0 * (close - col("__low")), width), "williams_r_14": ratio(-100.0 * (col("__high") - close), width),
        "__pdi": 100.0 * col("__plus_14") / tr, "__mdi": 100.0 * col("__minus_14") / tr, "__mean": col("__typical") / 20.0,
    }).withColumn("__dx", ratio(100.0 * F.abs(col("__pdi") - col("__mdi")), F.abs(col("__pdi") + col("__mdi"))))
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    apart = sum((F.abs(lag("__tp", k) - col("__mean")) for k in range(1, 20)), F.abs(col("__tp") - col("__mean")))
    df = df.withColumns({
        "stoch_d": mean(col("stoch_k"), 3), "adx_14": mean(col("__dx"), 14), "obv": F.sum("__signed").over(upto),
        "vwap": ratio(F.sum(col("__tp") * col("volume")).over(upto), F.sum("volume").over(upto)), "cci_20": ratio(col("__tp") - col("__mean"), 0.015 * (apart / 20)),
    })
    sma_20, band = col("__close_20") / 20.0, 2.0 * F.sqrt(col("__squares") / 19.0)
    table = {f"sma_{n}": col(f"__close_{n}") / float(n) for n in (5, 20, 50)} | {
        "rsi_14": 100.0 - 100.0 / (1.0 + ratio(col("__gain_14"), col("__loss_14"))), "stoch_k": col("stoch_k"), "stoch_d": col("stoch_d"), "adx_14": col("adx_14"), "bb_upper": sma_20 + band,
        "bb_middle": sma_20, "bb_lower": sma_20 - band, "atr_14": col("__tr_14") / 14.0, "obv": col("obv"), "vwap": col("vwap"), "daily_return_pct": col("daily_return_pct"),
        "log_return_pct": col("log_return_pct"), "roc_12": ratio(close - col("__back"), col("__back")) * 100.0, "cci_20": col("cci_20"), "williams_r_14": col("williams_r_14"),
    }
    e = Ema(df.select(*bars.columns, *[c.alias(name) for name, c in table.items()])).add("close", {f"ema_{n}": n for n in (12, 26, 50)})
    e = _macd(e, "ema_12", "ema_26")
    new = [c for c in e.df.columns if c not in (*bars.columns, "__pos", "__block", "__k")]
    return e.df.select(*bars.columns, *[(F.lag(c, shift).over(e.rows) if shift else F.col(c)).alias(c) for c in new])
