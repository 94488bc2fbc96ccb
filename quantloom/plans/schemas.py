"""Queries over columns and cells: headers, fills, projections, exports, selections, sequences and model hooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import scalars, schemas
from quantloom.functions.tables import cut
from quantloom.operators import changes, clean, dataset, fundamentals, labels, text
from quantloom.plans.fixtures import BARS, bars, table
from quantloom.plans.registry import SQL, query
from quantloom.plans.rounding import rounded
from quantloom.plans.rounding import sql_round as _r
from quantloom.plans.tables import STATEMENTS, statements

_W = "PARTITION BY symbol ORDER BY date"


@query("p1_p5_p9_canonical_columns", f"""WITH {BARS} SELECT symbol, date, {', '.join(_r(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))}, {_r('CASE WHEN day(date) % 5 <> 0 THEN close + 1 ELSE close END', 'adj_close')} FROM bars""")
def p1_canonical(spark, sf_dir):
    """Headers as sheets have them: repeated, blank, with the symbol behind the name."""
    b, d = bars(spark, sf_dir), F.dayofmonth("date")
    raw = b.select("symbol", "date", "open", "high", "low", "close", "volume", F.when(d % 5 != 0, F.col("close") + 1).alias("adj"), F.lit(0).alias("x"), F.lit(-1.0).alias("y"))
    heads = schemas.clean_headers([" symbol ", "Date_str", "Open_ABC.NS", "high  ABC", "LOW", "Close", "Volume_x", "Adj Close", "", "Close", " "])
    found = schemas.find_ohlcv(heads) | {"date": schemas.find_date(heads), "any": schemas.find_close(heads[6:])}
    assert found["close"] == "Close" and found["date"] == "Date_str" and found["any"] == "Close_2"
    df = raw.toDF(*heads)
    # canonicalize() keeps the canonical columns alone, so the symbol goes through as part of the day.
    keyed = df.withColumn("Date_str", F.struct("symbol", "Date_str"))
    out = schemas.canonicalize(keyed, "ABC").select("date.symbol", F.col("date.Date_str").alias("date"), "open", "high", "low", "close", "volume", "adj_close")
    return rounded(out, "open", "high", "low", "close", "volume", "adj_close")


@query("p4_date_by_values", f"WITH {BARS} SELECT symbol, date, {_r('close', 'close')} FROM bars")
def p4_date(spark, sf_dir):
    """A column without a telling name is found as its values are days."""
    df = bars(spark, sf_dir).select(F.date_format("date", "dd/MM/yyyy").alias("when"), "symbol", "close")
    col = schemas.find_date(df.columns, df)
    return rounded(df.withColumn("date", scalars.parse_date(F.col(col))), "close")


@query("p8_forward_fill", f"""WITH {BARS}, g AS (SELECT *, CASE WHEN day(date) % 4 = 0 THEN close END AS c FROM bars)
SELECT symbol, date, {_r(f'coalesce(last_value(c IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)', 'close')} FROM g""")
def p8_ffill(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("close", F.when(F.dayofmonth("date") % 4 == 0, F.col("close")))
    return rounded(df.withColumn("close", scalars.ffill("close", ["symbol"], "date")), "close")


@query("p10_p11_feature_projection", f"WITH {BARS} SELECT symbol, date, {_r('close', 'close')}, 0.0::DOUBLE AS absent, {_r('coalesce(CASE WHEN day(date) % 2 = 0 THEN open END, 0)', 'open')} FROM bars")
def p10_projection(spark, sf_dir):
    df = labels.forward_labels(bars(spark, sf_dir), range(1, 3)).withColumn("open", F.when(F.dayofmonth("date") % 2 == 0, F.col("open")))
    return rounded(schemas.project_features(schemas.drop_labels(df), ["close", "absent", "open"]), "close", "absent", "open")


_CELL = "CASE event_id % 8 WHEN 0 THEN 'NaN' WHEN 1 THEN ' none ' WHEN 2 THEN NULL WHEN 3 THEN 'true' WHEN 4 THEN 'FALSE' WHEN 5 THEN '-Infinity' WHEN 6 THEN ' ' || event_type || ' ' ELSE 'NaT' END"


@query("p13_cells", """SELECT event_id, CASE event_id % 8 WHEN 3 THEN '1' WHEN 4 THEN '0' WHEN 6 THEN event_type ELSE '' END AS cell, CASE event_id % 8 WHEN 3 THEN 'True' WHEN 4 THEN 'False' WHEN 6 THEN event_type ELSE '' END AS decision FROM events""", dated=False)
def p13_cells(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.expr(_CELL).alias("c"))
    return df.select("event_id", scalars.clean_cell(F.col("c")).alias("cell"), scalars.clean_cell(F.col("c"), "text").alias("decision"))


@query("p21_row_hashes", """SELECT o_orderkey, sha256(CASE WHEN o_orderkey % 3 = 0 THEN '["' || o_orderkey || '"]' WHEN o_orderkey % 3 = 1 THEN '["' || o_orderkey || '","","' || o_orderstatus || '"]' ELSE '["' || o_orderkey || '","' || o_orderpriority || '","' || o_orderstatus || '"]' END) AS row_hash FROM orders""", dated=False)
def p21_hashes(spark, sf_dir):
    """Blank cells at a row's end don't count, blank ones inside do."""
    k = F.col("o_orderkey")
    middle, end = F.when(k % 3 == 2, F.concat(F.lit(" "), "o_orderpriority")).when(k % 3 == 1, "  "), F.when(k % 3 != 0, F.col("o_orderstatus")).otherwise(" ")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.row_hash(k, middle, end, F.lit(None).cast("string")).alias("row_hash"))


@query("p22_financials_json", f"WITH {STATEMENTS} SELECT ticker, CAST(quarter_end AS VARCHAR) AS quarter, CASE WHEN n % 4 <> 0 THEN revenue END AS revenue, CASE WHEN n % 4 <> 0 THEN debt END AS debt FROM st", dated=False)
def p22_json(spark, sf_dir):
    """Items as JSON and back; a fourth of the texts is invalid."""
    one = fundamentals.encode_financials(statements(spark, sf_dir), ["revenue", "debt"])
    one = one.withColumn("financials", F.when(F.col("n") % 4 != 0, F.col("financials")).otherwise("{no json"))
    return fundamentals.decode_financials(one, ["revenue", "debt"]).select("ticker", F.col("quarter_end").cast("string").alias("quarter"), "revenue", "debt")


@query("p24_j6_export", f"""WITH {BARS}, n AS (SELECT symbol, row_number() OVER ({_W}) AS row_no, close FROM bars)
SELECT symbol, row_no, {_r('close', 'close')}, CASE WHEN row_no % 4 = 0 OR row_no % 8 = 1 THEN 1 ELSE 0 END AS predicted, CASE WHEN row_no % 4 = 0 THEN row_no * 2.0::DOUBLE END AS forecast FROM n""", dated=False)
def p24_export(spark, sf_dir):
    rows = bars(spark, sf_dir).select("symbol", F.row_number().over(Window.partitionBy("symbol").orderBy("date")).cast("long").alias("row_no"), "close", F.lit(1.0).alias("y_logret_h1"), F.lit(1).alias("__inner"))
    rows = rows.withColumns({"predicted": (F.col("row_no") % 8 == 1).cast("int"), "forecast": F.lit(None).cast("double")})
    out = changes.engineered_with_predictions(rows, rows.where("row_no % 4 = 0").select("symbol", "row_no", (F.col("row_no") * 2.0).alias("forecast")))
    assert set(out.columns) == {"symbol", "row_no", "close", "predicted", "forecast"}
    return rounded(out, "close", "predicted", "forecast", keys=("symbol", "row_no"))


_NAMES = "CASE WHEN symbol % 10 = 3 THEN 'Summary' WHEN symbol % 10 = 4 THEN ' meta' ELSE 'stock' || symbol END"


@query("f1_f5_f6_valid_stock_rows", f"WITH {BARS} SELECT 'stock' || symbol AS symbol, date, {_r('close', 'close')} FROM bars WHERE symbol % 10 NOT IN (3, 4) AND day(date) % 7 <> 0")
def f5_stocks(spark, sf_dir):
    """Neither tables that hold no stock, nor invalid bars, nor blank rows."""
    df = bars(spark, sf_dir).withColumns({"symbol": F.expr(_NAMES.replace("'stock' || symbol", "concat('stock', symbol)")), "high": F.when(F.dayofmonth("date") % 7 == 0, F.col("low") - 1).otherwise(F.col("high"))})
    blank = df.limit(0).unionByName(df.select("symbol").distinct(), allowMissingColumns=True).withColumn("symbol", F.lit("  "))
    full = clean.drop_blank_rows(df.unionByName(blank), ["symbol", "date", "close"])
    return rounded(clean.valid_ohlcv(clean.select_symbols(full)), "close")


@query("f5_u2_named_and_missing", f"WITH {BARS}, want AS (SELECT 'STOCK' || s_suppkey * 3 AS symbol FROM supplier), have AS (SELECT DISTINCT upper({_NAMES}) AS symbol FROM bars) SELECT symbol, EXISTS (SELECT 1 FROM have WHERE have.symbol = want.symbol) AS found FROM want", dated=False)
def f5_missing(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("symbol", F.expr(_NAMES.replace("'stock' || symbol", "concat('stock', symbol)")))
    want = table(spark, sf_dir, "supplier").select(F.concat(F.lit("STOCK"), F.col("s_suppkey") * 3).alias("symbol"))
    gone = clean.missing_symbols(df, want)
    return gone.withColumn("found", F.lit(False)).unionByName(want.join(gone, "symbol", "left_anti").withColumn("found", F.lit(True)))


@query("u2_missing_in_any_case", f"WITH {BARS}, want AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN ' stock' WHEN 1 THEN 'Stock' ELSE 'STOCK' END || s_suppkey * 3 || CASE s_suppkey % 2 WHEN 0 THEN ' ' ELSE '' END AS symbol FROM supplier), have AS (SELECT DISTINCT upper(trim({_NAMES})) AS symbol FROM bars) SELECT symbol FROM want WHERE upper(trim(symbol)) NOT IN (SELECT symbol FROM have)", dated=False)
def u2_missing(spark, sf_dir):
    """Names are wanted in lower, mixed and upper case, some with blanks around them."""
    k = F.col("s_suppkey")
    df = bars(spark, sf_dir).withColumn("symbol", F.expr(_NAMES.replace("'stock' || symbol", "concat('stock', symbol)")))
    start = F.element_at(F.array(F.lit(" stock"), F.lit("Stock"), F.lit("STOCK")), (k % 3 + 1).cast("int"))
    want = table(spark, sf_dir, "supplier").select(F.concat(start, k * 3, F.when(k % 2 == 0, " ").otherwise("")).alias("symbol"))
    return clean.missing_symbols(df, want)


@query("p5_headers_in_any_case", f"""WITH {BARS} SELECT symbol, date, {_r('close', 'Close')}, {_r('open', 'close_3')}, {_r('high', 'CLOSE_2')}, {_r('low', 'Column_6')}, volume AS volume FROM bars""")
def p5_headers(spark, sf_dir):
    """Headers that differ in their case only, one that has the number which the next would get, and a blank one."""
    heads = schemas.clean_headers(["symbol", "date", "Close", "close", "CLOSE_2", " ", "volume", ""])
    df = bars(spark, sf_dir).select("symbol", "date", "close", "open", "high", "low", "volume").toDF(*heads)
    return rounded(df, *heads[2:])


@query("f10_writable", f"""WITH {BARS}, p AS (SELECT symbol, date, row_number() OVER ({_W}) - 1 AS pos FROM bars)
SELECT symbol, date, pos, pos % 2 = 0 AS fresh FROM p WHERE pos % 5 > 2""")
def f10_writable(spark, sf_dir):
    """All valid forecasts, and which of them are on rows not predicted before."""
    p = labels.positions(bars(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))
    value = F.when(F.col("pos") % 5 == 1, float("nan")).when(F.col("pos") % 5 == 2, float("inf")).when(F.col("pos") % 5 > 2, 1.5)
    df = p.select("symbol", "date", "pos", value.alias("forecast"), (F.col("pos") % 2).cast("int").alias("predicted"))
    fresh = clean.writable(df).select("symbol", "date", F.lit(True).alias("fresh"))
    out = clean.writable(df, skip_predicted=False).join(fresh, ["symbol", "date"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    return rounded(out, "pos", "fresh")


_INFO = """i AS (SELECT DISTINCT ticker, 'sector' || ticker % 3 AS sector, 1e9::DOUBLE * (ticker + 1) AS market_cap, 10.0::DOUBLE + ticker AS pe_trailing, CASE WHEN ticker % 4 = 0 THEN 0.25::DOUBLE END AS roe_own, CASE WHEN ticker % 3 = 0 THEN 65.0::DOUBLE END AS percent FROM st)"""
_FLAT = f"""{STATEMENTS}, {_INFO}, y AS (SELECT *, lag(revenue, 4) OVER w AS r4, lag(net_income, 4) OVER w AS i4, row_number() OVER (PARTITION BY ticker ORDER BY quarter_end DESC) AS k FROM st WINDOW w AS (PARTITION BY ticker ORDER BY quarter_end)),
ev AS (SELECT o_custkey % 20 AS ticker, min(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) > DATE '1998-03-01') AS next_date FROM orders GROUP BY 1),
flat AS (SELECT y.ticker, sector, (revenue - r4) / nullif(abs(r4), 0) AS revenue_yoy, (net_income - i4) / nullif(abs(i4), 0) AS net_income_yoy, 0.3::DOUBLE * revenue / nullif(revenue, 0) AS operating_margin,
  coalesce(roe_own, coalesce(nullif(net_income, 0), revenue * 0.05) / nullif(equity, 0)) AS roe, coalesce(percent / 100, debt / nullif(equity, 0)) AS debt_to_equity,
  (CASE WHEN n % 5 <> 0 THEN revenue * 0.2 END - debt) / nullif(market_cap, 0) AS fcf_yield, pe_trailing, next_date - DATE '1998-03-01' AS days_to_earnings, coalesce(next_date - DATE '1998-03-01' BETWEEN 0 AND 5, false)::INT AS in_earnings_window_5d
  FROM y JOIN i USING (ticker) LEFT JOIN ev USING (ticker) WHERE k = 1)"""


def _flat(spark, sf_dir) -> DataFrame:
    q = statements(spark, sf_dir).withColumn("operating_income", F.col("revenue") * 0.3)
    t = F.col("ticker")
    info = q.select("ticker").distinct().select("ticker", F.concat(F.lit("sector"), t % 3).alias("sector"), (1e9 * (t + 1)).alias("market_cap"), (10.0 + t).alias("pe_trailing"), F.lit(None).cast("double").alias("pe_forward"), F.lit(None).cast("double").alias("pb"), F.when(t % 4 == 0, 0.25).alias("return_on_equity"), F.when(t % 3 == 0, 65.0).alias("debt_to_equity"))
    events = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("ticker"), F.to_date("o_orderdate").alias("event_date"))
    return fundamentals.flat_fundamentals(q, info, events, F.lit("1998-03-01").cast("date")).withColumn("days_to_earnings", F.col("days_to_earnings").cast("long"))


_FLAT_COLS = ("revenue_yoy", "net_income_yoy", "operating_margin", "debt_to_equity", "pe_trailing")


@query("p18_flat_fundamentals", f"WITH {_FLAT} SELECT ticker, sector, {', '.join(_r(c, c) for c in _FLAT_COLS)}, {_r('roe', 'roe', 3)}, {_r('fcf_yield', 'fcf_yield', 6)}, days_to_earnings, in_earnings_window_5d FROM flat", dated=False)
def p18_flat(spark, sf_dir):
    df = _flat(spark, sf_dir)
    out = rounded(df, *_FLAT_COLS, "sector", "days_to_earnings", "in_earnings_window_5d", keys=("ticker",))
    return out.join(df.select("ticker", (F.round(F.col("roe") + 3e-7, 3) + 0.0).alias("roe"), (F.round(F.col("fcf_yield") + 3e-7, 6) + 0.0).alias("fcf_yield")), "ticker")


@query("j4_attach_fundamentals", f"WITH {BARS}, {_FLAT} SELECT symbol, date, {_r('close', 'close')}, flat.sector, {_r('flat.debt_to_equity', 'debt_to_equity')} FROM bars LEFT JOIN flat ON bars.symbol = flat.ticker")
def j4_attach(spark, sf_dir):
    return rounded(fundamentals.attach_fundamentals(bars(spark, sf_dir), _flat(spark, sf_dir).select("ticker", "sector", "debt_to_equity")), "close", "sector", "debt_to_equity")


@query("a21_quarter_source", f"""WITH {STATEMENTS}, a AS (SELECT ticker, quarter_end, 0 AS source FROM st WHERE n % 3 <> 0), b AS (SELECT ticker, quarter_end, 1 AS source FROM st WHERE n % 2 = 0 OR ticker % 2 = 0),
u AS (SELECT *, count(*) OVER (PARTITION BY ticker, source) AS c FROM (SELECT * FROM a UNION ALL SELECT * FROM b)), w AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY c DESC, source) AS best FROM u),
k AS (SELECT ticker, quarter_end, source, row_number() OVER (PARTITION BY ticker ORDER BY quarter_end DESC) AS rank FROM w WHERE best = 1) SELECT ticker, CAST(quarter_end AS VARCHAR) AS quarter, source, rank FROM k WHERE rank <= 4""", dated=False)
def a21_source(spark, sf_dir):
    st = statements(spark, sf_dir)
    out = fundamentals.best_source([st.where("n % 3 <> 0"), st.where("n % 2 = 0 or ticker % 2 = 0")])
    return out.select("ticker", F.col("quarter_end").cast("string").alias("quarter"), "source", F.col("rank").cast("long").alias("rank"))


@query("a18_common_features", f"""WITH {BARS}, f AS (SELECT symbol, unnest(['open', 'close', 'thin']) AS feature, unnest([open, close, CASE WHEN symbol % 5 <> 0 THEN close END]) AS v FROM bars),
s AS (SELECT feature, symbol, count(v) AS n FROM f GROUP BY ALL) SELECT feature FROM s GROUP BY feature HAVING min(n) > 0""", dated=False)
def a18_features(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("thin", F.when(F.col("symbol") % 5 != 0, F.col("close")))
    return spark.createDataFrame([(c,) for c in dataset.common_features(df, ["open", "close", "thin"])], "feature string")


_COLS = ("open", "high", "low", "close")


def _steps(df: DataFrame, steps: dict[str, int]) -> DataFrame:
    """Columns of chosen steps of sequences, counted from the end."""
    at = lambda k, f: F.element_at(F.element_at("features", -k), f + 1)
    return rounded(df.select("symbol", "date", *[at(k, f).alias(f"{c}_{name}") for name, k in steps.items() for f, c in enumerate(_COLS)]), *[f"{c}_{name}" for name in steps for c in _COLS])


def _lags(steps: dict[str, int], shift: int = 0) -> str:
    return ", ".join(_r(f"lag({c}, {k - 1 + shift}) OVER ({_W})", f"{c}_{name}") for name, k in steps.items() for c in _COLS)


@query("t1_t11_sequences", f"WITH {BARS}, s AS (SELECT symbol, date, row_number() OVER ({_W}) AS n, {_lags({'last': 1, 'third': 3, 'fifth': 5})} FROM bars) SELECT * EXCLUDE (n) FROM s WHERE n >= 20")
def t1_sequences(spark, sf_dir):
    """The last five of twenty steps that end at each bar."""
    return _steps(dataset.tail(dataset.sequences(bars(spark, sf_dir), list(_COLS), 20), 5), {"last": 1, "third": 3, "fifth": 5})


@query("t2_sequences_before", f"WITH {BARS}, s AS (SELECT symbol, date, row_number() OVER ({_W}) AS n, {_lags({'last': 1, 'tenth': 10, 'first': 20}, 1)} FROM bars) SELECT * EXCLUDE (n) FROM s WHERE n > 20")
def t2_sequences(spark, sf_dir):
    return _steps(dataset.sequences(bars(spark, sf_dir), list(_COLS), 20, include_anchor=False), {"last": 1, "tenth": 10, "first": 20})


@query("t9_open_override", f"WITH {BARS}, s AS (SELECT symbol, date, row_number() OVER ({_W}) AS n, {_lags({'last': 1, 'second': 2})} FROM bars) SELECT * EXCLUDE (n) REPLACE ({_r('n / 2.0::DOUBLE', 'open_last').split(' AS ')[0]} AS open_last) FROM s WHERE n >= 20")
def t9_override(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("now", F.row_number().over(Window.partitionBy("symbol").orderBy("date")) / 2.0)
    return _steps(dataset.override_last(dataset.sequences(df, list(_COLS), 20), 0, "now"), {"last": 1, "second": 2})


@query("t8_next_close_pairs", f"WITH {BARS}, s AS (SELECT symbol, date, row_number() OVER ({_W}) AS n, {_r(f'lag(close, 20) OVER ({_W})', 'first')}, {_r(f'lag(close, 1) OVER ({_W})', 'last')}, {_r('close', 'target')} FROM bars) SELECT * EXCLUDE (n) FROM s WHERE n > 20")
def t8_pairs(spark, sf_dir):
    df = labels.next_close_pairs(bars(spark, sf_dir), 20)
    return rounded(df.withColumns({"first": F.element_at("window", 1), "last": F.element_at("window", -1)}), "first", "last", "target")


@query("t10_checkpoints", f"""WITH {BARS}, m AS (SELECT symbol, max(date) AS d FROM bars WHERE date <= DATE '2000-06-30' GROUP BY symbol), i AS (SELECT bars.symbol, date, row_number() OVER (PARTITION BY bars.symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY bars.symbol) AS n FROM bars LEFT JOIN m USING (symbol) WHERE m.d IS NULL OR date > m.d),
t AS (SELECT symbol, max(date) AS d FROM i WHERE i < n - least(5, greatest(1, n // 3)) GROUP BY symbol) SELECT symbol, CAST(coalesce(t.d, m.d) AS VARCHAR) AS last_date FROM m FULL JOIN t USING (symbol)""", dated=False)
def t10_checkpoints(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "date")
    marks = b.where("date <= date '2000-06-30'").groupBy("symbol").agg(F.max("date").alias("last_date"))
    out = dataset.advance_checkpoints(marks, dataset.incremental_examples(b, marks))
    return out.select("symbol", F.col("last_date").cast("string").alias("last_date"))


def _letters(texts: list[str]) -> pd.DataFrame:
    pos, neg = ([t.count(x) / max(1, len(t)) for t in texts] for x in "et")
    return pd.DataFrame({"positive": pos, "negative": neg, "neutral": [1 - p - n for p, n in zip(pos, neg, strict=True)], "polarity": [p - n for p, n in zip(pos, neg, strict=True)]})


_SHARE = "(length(t) - length(replace(t, '{}', ''))) / greatest(length(t), 1)::DOUBLE"


@query("u1_text_scorer", f"WITH d AS (SELECT doc_id, left(coalesce(text, ''), 512) AS t FROM documents) SELECT doc_id, {_r(_SHARE.format('e'), 'positive')}, {_r(_SHARE.format('e') + ' - ' + _SHARE.format('t'), 'polarity')} FROM d", dated=False)
def u1_scorer(spark, sf_dir):
    """A model hook with a model of letters; it reads the 512 characters that such models take."""
    return rounded(text.score_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", lambda: _letters), "positive", "polarity", keys=("doc_id",))


_GOOD, _BAD = ["good", "the", "thing"], ["bad", "and", "not"]


def _times(words: list[str]) -> str:
    return f"len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x IN ({', '.join(repr(w) for w in words)})))"


@query("u1_lexicon_scorer", f"WITH d AS (SELECT doc_id, {_times(_GOOD)} AS p, {_times(_BAD)} AS n FROM documents) SELECT doc_id, {_r('p / greatest(p + n, 1)::DOUBLE', 'positive')}, {_r('(p - n) / greatest(p + n, 1)::DOUBLE', 'polarity')} FROM d", dated=False)
def u1_lexicon(spark, sf_dir):
    return rounded(text.lexicon_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _GOOD, _BAD), "positive", "polarity", keys=("doc_id",))


@query("u2_sequence_scorer", f"WITH {BARS}, s AS (SELECT symbol, date, row_number() OVER ({_W}) AS n, (close - lag(close, 19) OVER ({_W})) / 19 AS step FROM bars) SELECT symbol, date, h AS horizon, {_r('step * h', 'pred')} FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS h) WHERE n >= 20")
def u2_scorer(spark, sf_dir):
    seq = dataset.sequences(bars(spark, sf_dir), ["open", "close"], 20)
    return rounded(dataset.score_sequences(seq, ["symbol", "date"], dataset.momentum()), "pred", keys=("symbol", "date", "horizon"))


@query("u2_t1_block_sequences", SQL["u2_sequence_scorer"], dated=False)
def u2_blocks(spark, sf_dir):
    """The same scores from sequences that are written as blocks of bars."""
    blocks = cut(dataset.sequence_blocks(bars(spark, sf_dir), ["open", "close"], 20, size=256), "sequence-blocks")
    return rounded(dataset.score_blocks(blocks, dataset.momentum(), 20), "pred", keys=("symbol", "date", "horizon"))
