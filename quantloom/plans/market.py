"""Queries over bars: indicators, labels, regime, cross-section."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import blocks, labels, regime
from quantloom.operators import indicators as ind
from quantloom.plans.fixtures import BARS, DEEP, INDEX, MACD_ROWS, NUMBERED, bars, deep_bars, index, table
from quantloom.plans.registry import query
from quantloom.plans.rounding import rounded
from quantloom.plans.rounding import sql_round as _r


_W = "PARTITION BY symbol ORDER BY date"


def _t(n: int) -> str:
    return f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {_t(n)} = {n} THEN {agg} {_t(n)} END"


_LAG = f"lag(close) OVER ({_W})"


@query("w33_bars", f"WITH {BARS} SELECT symbol, date, {_r('open', 'open')}, {_r('high', 'high')}, {_r('low', 'low')}, {_r('close', 'close')}, volume FROM bars")
def w33_bars(spark, sf_dir):
    return rounded(bars(spark, sf_dir), "open", "high", "low", "close", "volume")


@query("sma_returns", f"""WITH {BARS} SELECT symbol, date, {_r(_full('avg(close)', 'close', 5), 'sma_5')}, {_r(_full('avg(close)', 'close', 20), 'sma_20')},
  {_r(_full('avg(close)', 'close', 50), 'sma_50')}, {_r(f'(close / {_LAG} - 1) * 100', 'daily_return_pct')}, {_r(f'ln(close / {_LAG}) * 100', 'log_return_pct')} FROM bars""")
def sma_returns(spark, sf_dir):
    df = ind.returns(bars(spark, sf_dir)).withColumns({f"sma_{n}": ind.sma(n) for n in (5, 20, 50)})
    return rounded(df, "sma_5", "sma_20", "sma_50", "daily_return_pct", "log_return_pct")


@query("w1_rsi", f"""WITH {BARS}, d AS (SELECT *, close - {_LAG} AS d FROM bars),
g AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss FROM d)
SELECT symbol, date, {', '.join(_r(f"100 - 100 / (1 + ({_full('avg(gain)', 'gain', n)}) / nullif({_full('avg(loss)', 'loss', n)}, 0))", f'rsi_{n}') for n in (7, 14))} FROM g""")
def w1_rsi(spark, sf_dir):
    return rounded(ind.rsi(ind.rsi(bars(spark, sf_dir), 7), 14), "rsi_7", "rsi_14")


@query("w3_stochastic_w15_williams", f"""WITH {DEEP}, k AS (SELECT *, {_full('min(low)', 'low', 14)} AS lo, {_full('max(high)', 'high', 14)} AS hi FROM bars),
s AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS k FROM k)
SELECT symbol, date, {_r('k', 'stoch_k')}, {_r(_full('avg(k)', 'k', 3), 'stoch_d')}, {_r('-100 * (hi - close) / nullif(hi - lo, 0)', 'williams_r_14')} FROM s""")
def w3_w15(spark, sf_dir):
    return rounded(ind.williams_r(ind.stochastic(deep_bars(spark, sf_dir))), "stoch_k", "stoch_d", "williams_r_14")


@query("w5_ema_w2_macd", f"""WITH RECURSIVE {DEEP}, {MACD_ROWS}
SELECT num.symbol, num.date, {_r('e12.y', 'ema_12')}, {_r('e26.y', 'ema_26')}, {_r('e50.y', 'ema_50')}, {_r('m.close', 'macd')}, {_r('s.y', 'macd_signal')}, {_r('m.close - s.y', 'macd_hist')}
FROM num JOIN e12 USING (symbol, n) JOIN e26 USING (symbol, n) JOIN e50 USING (symbol, n) JOIN m USING (symbol, n) JOIN s USING (symbol, n)""")
def w5_w2(spark, sf_dir):
    df = ind.Ema(ind.macd(deep_bars(spark, sf_dir))).add("close", {f"ema_{n}": n for n in (12, 26, 50)}).done()
    return rounded(df, "ema_12", "ema_26", "ema_50", "macd", "macd_signal", "macd_hist")


_TR = f"greatest(high - low, coalesce(abs(high - {_LAG}), high - low), coalesce(abs(low - {_LAG}), high - low))"


@query("w6_adx_w8_atr", f"""WITH {DEEP}, d AS (SELECT *, high - lag(high) OVER ({_W}) AS up, lag(low) OVER ({_W}) - low AS down, {_TR} AS tr FROM bars),
m AS (SELECT *, CASE WHEN up > 0 AND up > greatest(down, 0) THEN up ELSE 0 END AS p, CASE WHEN down > 0 AND down > greatest(up, 0) THEN down ELSE 0 END AS q FROM d),
i AS (SELECT *, 100 * ({_full('sum(p)', 'p', 14)}) / nullif({_full('sum(tr)', 'tr', 14)}, 0) AS pdi, 100 * ({_full('sum(q)', 'q', 14)}) / nullif({_full('sum(tr)', 'tr', 14)}, 0) AS mdi FROM m),
x AS (SELECT *, 100 * abs(pdi - mdi) / nullif(abs(pdi + mdi), 0) AS dx FROM i)
SELECT symbol, date, {_r(_full('avg(dx)', 'dx', 14), 'adx_14')}, {_r(_full('avg(tr)', 'tr', 14), 'atr_14')} FROM x""")
def w6_w8(spark, sf_dir):
    return rounded(ind.atr(ind.adx(deep_bars(spark, sf_dir))), "adx_14", "atr_14")


@query("w7_bollinger", f"""WITH {BARS}, s AS (SELECT *, {_full('avg(close)', 'close', 20)} AS m, {_full('stddev_samp(close)', 'close', 20)} AS s FROM bars)
SELECT symbol, date, {_r('m + 2 * s', 'bb_upper')}, {_r('m', 'bb_middle')}, {_r('m - 2 * s', 'bb_lower')} FROM s""")
def w7_bollinger(spark, sf_dir):
    return rounded(ind.bollinger(bars(spark, sf_dir)), "bb_upper", "bb_middle", "bb_lower")


@query("w9_obv_w10_vwap", f"""WITH {BARS}, s AS (SELECT *, coalesce(sign(close - {_LAG}), 0) * volume AS v FROM bars)
SELECT symbol, date, {_r(f'sum(v) OVER ({_W})', 'obv')}, {_r(f'sum((high + low + close) / 3 * volume) OVER ({_W}) / nullif(sum(volume) OVER ({_W}), 0)', 'vwap')} FROM s""")
def w9_w10(spark, sf_dir):
    return rounded(ind.vwap(ind.obv(bars(spark, sf_dir))), "obv", "vwap")


@query("w13_roc_w14_cci", f"""WITH {DEEP}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
m AS (SELECT *, {_full('avg(tp)', 'tp', 20)} AS m, list(tp) {_t(20)} AS l FROM t)
SELECT symbol, date, {_r(f'(close - lag(close, 12) OVER ({_W})) / nullif(lag(close, 12) OVER ({_W}), 0) * 100', 'roc_12')},
  {_r('(tp - m) / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - m))), 0)', 'cci_20')} FROM m""")
def w13_w14(spark, sf_dir):
    return rounded(ind.cci(ind.roc(deep_bars(spark, sf_dir))), "roc_12", "cci_20")


@query("w16_forward_labels", f"""WITH {BARS} SELECT symbol, date, {', '.join(_r(f'lead(ln(close), {h}) OVER ({_W}) - ln(close)', f'y_logret_h{h}') for h in range(1, 31))},
  lead(close, 30) OVER ({_W}) IS NOT NULL AS has_labels FROM bars""")
def w16_labels(spark, sf_dir):
    return rounded(labels.forward_labels(bars(spark, sf_dir)), *[f"y_logret_h{h}" for h in range(1, 31)], "has_labels")


@query("w17_target_labels", f"""WITH {BARS} SELECT symbol, date, {', '.join(_r(f'ln(lead(close, {h - 1}) OVER ({_W}) / {_LAG})', f'y_logret_h{h}') for h in range(1, 6))},
  row_number() OVER ({_W}) - 1 AS pos FROM bars""")
def w17_labels(spark, sf_dir):
    return rounded(labels.positions(labels.target_labels(bars(spark, sf_dir))).withColumn("pos", F.col("pos").cast("long")), *[f"y_logret_h{h}" for h in range(1, 6)], "pos")


@query("w23_lag_features", f"""WITH {BARS}, l AS (SELECT symbol, date, open, close, volume, {', '.join(f'lag({c}, {k}) OVER ({_W}) AS {c}_lag{k}' for c in ('high', 'close') for k in (1, 2, 3))} FROM bars)
SELECT symbol, date, {', '.join(_r(f'{c}_lag{k}', f'{c}_lag{k}') for c in ('high', 'close') for k in (1, 2, 3))}, {_r('close', 'close')} FROM l WHERE close_lag3 IS NOT NULL""")
def w23_lags(spark, sf_dir):
    df = labels.lag_features(bars(spark, sf_dir), ["high", "close"])
    return rounded(df, *[f"{c}_lag{k}" for c in ("high", "close") for k in (1, 2, 3)], "close")


_D = "OVER (ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _dfull(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {_D.format(n - 1)} = {n} THEN {agg} {_D.format(n - 1)} END"


REGIME = f"""r0 AS (SELECT *, ln(mkt_close) - lag(ln(mkt_close)) OVER (ORDER BY date) AS mkt_log_return FROM idx),
regime AS (SELECT date, mkt_close, mkt_log_return, mkt_close / lag(mkt_close, 20) OVER (ORDER BY date) - 1 AS mkt_return_20d,
  ({_dfull('stddev_samp(mkt_log_return)', 'mkt_log_return', 20)}) * sqrt(252) AS mkt_vol_20d,
  (({_dfull('avg(mkt_close)', 'mkt_close', 50)}) - ({_dfull('avg(mkt_close)', 'mkt_close', 200)})) / ({_dfull('avg(mkt_close)', 'mkt_close', 200)}) AS mkt_trend,
  vol_close AS vol_level, vol_close - lag(vol_close, 5) OVER (ORDER BY date) AS vol_delta_5d,
  coalesce(vol_close > ({_dfull('quantile_cont(vol_close, 0.5)', 'vol_close', 252)}), false)::INT AS regime_high_vol FROM r0)"""
_REGIME_COLS = ("mkt_close", "mkt_log_return", "mkt_return_20d", "mkt_vol_20d", "mkt_trend", "vol_level", "vol_delta_5d")


@query("w18_w20_regime", f"WITH {INDEX}, {REGIME} SELECT date, {', '.join(_r(c, c) for c in _REGIME_COLS)}, regime_high_vol, coalesce(mkt_trend > 0, false)::INT AS regime_up FROM regime")
def w18_regime(spark, sf_dir):
    return rounded(regime.regime(index(spark, sf_dir)), *_REGIME_COLS, "regime_high_vol", "regime_up", keys=("date",))


@query("w21_w22_j1_relative_strength_beta", f"""WITH {BARS}, {INDEX}, {REGIME}, j AS (SELECT bars.*, mkt_return_20d, mkt_log_return FROM bars LEFT JOIN regime USING (date)),
k AS (SELECT *, ln(close) - ln({_LAG}) AS r, close / lag(close, 20) OVER ({_W}) - 1 AS return_20d FROM j),
p AS (SELECT *, CASE WHEN r IS NOT NULL AND mkt_log_return IS NOT NULL THEN 1 END AS ok FROM k)
SELECT symbol, date, {_r('return_20d', 'return_20d')}, {_r('return_20d - mkt_return_20d', 'rel_strength_20d')},
  {_r(f"(CASE WHEN count(ok) {_t(60)} = 60 THEN covar_samp(r, mkt_log_return) {_t(60)} END) / nullif({_full('var_samp(mkt_log_return)', 'mkt_log_return', 60)}, 0)", 'beta_60d')} FROM p""")
def w21_beta(spark, sf_dir):
    df = regime.attach_regime(bars(spark, sf_dir), regime.regime(index(spark, sf_dir)))
    return rounded(regime.beta(regime.relative_strength(df)), "return_20d", "rel_strength_20d", "beta_60d")


@query("w30_rank_p14_calendar", f"""WITH {BARS}, r AS (SELECT symbol, date, (close / {_LAG} - 1) * 100 AS ret FROM bars)
SELECT symbol, date, {_r("CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0) / count(ret) OVER (PARTITION BY date) END", 'ret_rank')},
  isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, (last_day(date) - date) AS days_to_month_end FROM r""")
def w30_rank(spark, sf_dir):
    df = ind.returns(bars(spark, sf_dir)).withColumnRenamed("daily_return_pct", "ret")
    out = rounded(regime.calendar(regime.pct_rank(df, "ret", "date")), "ret_rank", "day_of_week", "day_of_month", "days_to_month_end")
    return out.withColumns({c: F.col(c).cast("long") for c in ("day_of_week", "day_of_month", "days_to_month_end")})


#: Bars of which some are invalid (high under low, or a close of 0) and some have no volume.
FLAWED = f"""{DEEP.replace('bars AS', 'b0 AS', 1)}, bars AS (SELECT symbol, date, open, CASE WHEN day(date) % 7 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN day(date) % 11 = 0 THEN 0 ELSE close END AS close, CASE WHEN day(date) % 5 <> 0 THEN volume END AS volume FROM b0)"""
_UPTO = f"OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
STATS = f"""valid AS (SELECT symbol, date, quantile_cont((high - low) / close, 0.5) {_t(20)} AS med FROM bars WHERE close > 0 AND high >= low), full_ AS (SELECT symbol, date, avg(volume) {_t(20)} AS vol FROM bars WHERE volume IS NOT NULL),
stats AS (SELECT symbol, date, close AS last_close, last_value(vol IGNORE NULLS) {_UPTO} AS mean_volume, coalesce(least(greatest(last_value(med IGNORE NULLS) {_UPTO}, 0.005), 0.05), 0.02) AS median_range FROM bars LEFT JOIN valid USING (symbol, date) LEFT JOIN full_ USING (symbol, date))"""


def flawed_bars(spark, sf_dir):
    d = F.dayofmonth("date")
    return deep_bars(spark, sf_dir).withColumns({"high": F.when(d % 7 == 0, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(d % 11 == 0, 0.0).otherwise(F.col("close")), "volume": F.when(d % 5 != 0, F.col("volume"))})


@query("w32_trailing_stats", f"WITH {FLAWED}, {STATS} SELECT symbol, date, {_r('last_close', 'last_close')}, {_r('mean_volume', 'mean_volume')}, {_r('median_range', 'median_range')} FROM stats")
def w32_trailing(spark, sf_dir):
    return rounded(regime.trailing_stats(flawed_bars(spark, sf_dir)), "last_close", "mean_volume", "median_range")


_P = f"lag(close, 1) OVER ({_W})"
#: Each indicator over tables that come one from another; all are lagged one bar at the end.
_TABLE = {
    "ema_12": "e12.y", "ema_26": "e26.y", "ema_50": "e50.y", "macd": "m.close", "macd_signal": "s.y", "macd_hist": "m.close - s.y",
    **{f"sma_{n}": f"sma_{n}" for n in (5, 20, 50)}, "rsi_14": "100 - 100 / (1 + gain14 / nullif(loss14, 0))", "stoch_k": "k", "stoch_d": "d", "adx_14": "adx", "bb_upper": "sma_20 + 2 * sd", "bb_middle": "sma_20", "bb_lower": "sma_20 - 2 * sd",
    "atr_14": "atr", "obv": "obv", "vwap": "vwap", "daily_return_pct": "(close0 / p - 1) * 100", "log_return_pct": "ln(close0 / p) * 100", "roc_12": "(close0 - p12) / nullif(p12, 0) * 100",
    "cci_20": "(tp - tm) / nullif(0.015 * list_avg(list_transform(tl, lambda x: abs(x - tm))), 0)", "williams_r_14": "-100 * (hh - close0) / nullif(hh - ll, 0)",
}
_W25 = f"""WITH RECURSIVE {BARS}, {MACD_ROWS},
a AS (SELECT *, {_P} AS p, lag(close, 12) OVER ({_W}) AS p12, (high + low + close) / 3 AS tp, high - lag(high) OVER ({_W}) AS up, lag(low) OVER ({_W}) - low AS down, {_TR} AS tr FROM num),
b AS (SELECT *, CASE WHEN close > p THEN close - p ELSE 0 END AS gain, CASE WHEN close < p THEN p - close ELSE 0 END AS loss, CASE WHEN up > 0 AND up > greatest(down, 0) THEN up ELSE 0 END AS pm, CASE WHEN down > 0 AND down > greatest(up, 0) THEN down ELSE 0 END AS qm, coalesce(sign(close - p), 0) * volume AS sv,
  {_full('min(low)', 'low', 14)} AS ll, {_full('max(high)', 'high', 14)} AS hh, {_full('avg(tp)', 'tp', 20)} AS tm, list(tp) {_t(20)} AS tl FROM a),
c AS (SELECT *, {', '.join(f"{_full('avg(close)', 'close', n)} AS sma_{n}" for n in (5, 20, 50))}, {_full('stddev_samp(close)', 'close', 20)} AS sd, {_full('avg(gain)', 'gain', 14)} AS gain14, {_full('avg(loss)', 'loss', 14)} AS loss14, 100 * (close - ll) / nullif(hh - ll, 0) AS k,
  100 * ({_full('sum(pm)', 'pm', 14)}) / nullif({_full('sum(tr)', 'tr', 14)}, 0) AS pdi, 100 * ({_full('sum(qm)', 'qm', 14)}) / nullif({_full('sum(tr)', 'tr', 14)}, 0) AS mdi, {_full('avg(tr)', 'tr', 14)} AS atr, sum(sv) OVER ({_W}) AS obv, sum(tp * volume) OVER ({_W}) / nullif(sum(volume) OVER ({_W}), 0) AS vwap FROM b),
x AS (SELECT *, close AS close0, 100 * abs(pdi - mdi) / nullif(abs(pdi + mdi), 0) AS dx, {_full('avg(k)', 'k', 3)} AS d FROM c), z AS (SELECT *, {_full('avg(dx)', 'dx', 14)} AS adx FROM x),
t AS (SELECT z.symbol, z.date, z.open, z.high, z.low, close0 AS close, z.volume, {', '.join(f'{x} AS {c}' for c, x in _TABLE.items())} FROM z JOIN e12 USING (symbol, n) JOIN e26 USING (symbol, n) JOIN e50 USING (symbol, n) JOIN m USING (symbol, n) JOIN s USING (symbol, n))
SELECT symbol, date, {', '.join(_r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))}, {', '.join(_r(f'lag({c}) OVER ({_W})', c) for c in _TABLE)} FROM t"""


@query("w25_indicator_table", _W25)
def w25_indicators(spark, sf_dir):
    """Java compiles no method of more than 8,000 bytes, as one that rounds all columns is in whole-stage code, so such stages are left without it (for the session, unless the user has a limit)."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) == 65535:
        spark.conf.set(limit, "8000")
    df = ind.indicators(bars(spark, sf_dir))
    return rounded(df, *[c for c in df.columns if c not in ("symbol", "date")])


#: All events as bars of one symbol, one after the other, and its exponential means over windows beyond which weights are below a double's precision.
EVENT_BARS = "bars AS (SELECT 0 AS symbol, event_id AS date, value AS open, value + event_id % 5 AS high, value - event_id % 3 AS low, value AS close, CAST(event_id % 7 AS DOUBLE) AS volume FROM events)"


def _mean_sql(name: str, span: int, src: str = "num", x: str = "close") -> str:
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"{name} AS (SELECT symbol, n, list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY n ROWS 1100 PRECEDING), lambda y, x: {a} * x + (1 - {a}) * y) AS y FROM {src})"


_LONG = _W25.replace(f"WITH RECURSIVE {BARS}, {MACD_ROWS}", f"WITH {EVENT_BARS}, {NUMBERED}, {', '.join(_mean_sql(f'e{n}', n) for n in (12, 26, 50))}, m AS (SELECT a.symbol, a.n, a.y - b.y AS close FROM e12 a JOIN e26 b ON a.symbol = b.symbol AND a.n = b.n), {_mean_sql('s', 9, 'm')}")


@query("w25_long_symbol", _LONG, dated=False)
def w25_long(spark, sf_dir):
    """One symbol that has all rows, by blocks."""
    e, value = F.col("event_id"), F.col("value")
    b = table(spark, sf_dir, "events").select(F.lit(0).alias("symbol"), e.alias("date"), value.alias("open"), (value + e % 5).alias("high"), (value - e % 3).alias("low"), value.alias("close"), (e % 7).cast("double").alias("volume"))
    df = blocks.long_indicators(b, size=2048)
    return rounded(df, *[c for c in df.columns if c not in ("symbol", "date")])


@query("j2_index_merge", f"WITH {INDEX}, a AS (SELECT date, mkt_close FROM idx WHERE day(date) % 7 <> 0), b AS (SELECT date, vol_close FROM idx WHERE day(date) % 5 <> 0) SELECT date, {_r('mkt_close', 'mkt_close')}, {_r('vol_close', 'vol_close')} FROM a FULL JOIN b USING (date)")
def j2_merge(spark, sf_dir):
    i = index(spark, sf_dir)
    df = regime.merge_indices(i.where(F.dayofmonth("date") % 7 != 0).select("date", "mkt_close"), i.where(F.dayofmonth("date") % 5 != 0).select("date", "vol_close"))
    return rounded(df, "mkt_close", "vol_close", keys=("date",))
