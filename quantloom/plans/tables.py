"""Queries over dirty bars, snapshots, statements and decision features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import scalars
from quantloom.functions.tables import cut, new_path
from quantloom.operators import changes, clean, decision, fundamentals
from quantloom.plans.fixtures import BARS, DEEP, EMA_ROWS, bars, deep_bars, table
from quantloom.plans.registry import query
from quantloom.plans.rounding import rounded
from quantloom.plans.rounding import sql_round as _r

_W = "PARTITION BY symbol ORDER BY date"
#: Bars as text: every 13th row of a symbol twice, every 17th with high below low, every 19th with a bad date.
DIRTY = f"""{BARS}, numbered AS (SELECT *, row_number() OVER ({_W}) AS n FROM bars),
raw AS (SELECT symbol, n * 2 + k AS seq, CASE WHEN n % 19 = 0 THEN NULL ELSE date END AS date, open, CASE WHEN n % 17 = 0 THEN low - 1 ELSE high END AS high, low, close + k AS close, 1000 + volume AS volume
  FROM numbered CROSS JOIN (VALUES (0), (1)) v(k) WHERE k = 0 OR n % 13 = 0),
flagged AS (SELECT *, CASE WHEN date IS NULL THEN 'date' WHEN high < low THEN 'range' WHEN close <= 0 THEN 'close' END AS reason FROM raw)"""


def dirty_text(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    df = bars(spark, sf_dir).withColumn("n", F.row_number().over(w).cast("long"))
    df = df.withColumn("k", F.explode(F.when(F.col("n") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    volume = F.concat(F.lit(" 1,"), F.lpad(F.col("volume").cast("long").cast("string"), 3, "0"))
    return df.select(
        "symbol", (F.col("n") * 2 + F.col("k")).alias("seq"), F.when(F.col("n") % 19 == 0, "not a date").otherwise(F.date_format("date", "dd/MM/yyyy")).alias("date"), F.col("open").cast("string").alias("open"),
        F.when(F.col("n") % 17 == 0, F.col("low") - 1).otherwise(F.col("high")).cast("string").alias("high"), F.col("low").cast("string").alias("low"), (F.col("close") + F.col("k")).cast("string").alias("close"), volume.alias("volume"),
    )


def dirty(spark, sf_dir) -> DataFrame:
    return clean.typed(dirty_text(spark, sf_dir))


@query("f1_f2_p6_p7_malformed", f"WITH {DIRTY} SELECT symbol, seq, date, {_r('close', 'close')}, volume, reason FROM flagged")
def f2_malformed(spark, sf_dir):
    df = clean.flag_malformed(dirty(spark, sf_dir))
    return rounded(df, "close", "reason", keys=("symbol", "seq", "date", "volume"))


@query("a25_a19_repair", f"""WITH {DIRTY}, k AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY symbol, date, reason IS NULL ORDER BY seq DESC) END AS k,
  date < lag(date) OVER (PARTITION BY symbol ORDER BY seq) AS down FROM flagged),
g AS (SELECT symbol, count(*) AS before, count(*) FILTER (k = 1) AS after, count(*) FILTER (reason IS NOT NULL) AS malformed, count(*) FILTER (k > 1) AS duplicates, count(*) FILTER (down) = 0 AS was_sorted, count(*) FILTER (reason IS NULL) AS repaired_cells FROM k GROUP BY symbol)
SELECT *, CASE WHEN after = 0 THEN 'error' WHEN before = after AND repaired_cells = 0 THEN CASE WHEN was_sorted THEN 'clean' ELSE 'sorted' END ELSE 'repaired' END AS status FROM g""", dated=False)
def a25_repair(spark, sf_dir):
    """The days alone are written otherwise than in the repaired table."""
    return clean.repair(clean.typed_cells(dirty_text(spark, sf_dir)))[1]


@query("a25_a28_observed_repair", f"""WITH {DIRTY}, k AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY symbol, date, reason IS NULL ORDER BY seq DESC) END AS k FROM flagged),
t AS (SELECT count(*) AS before, count(*) FILTER (k = 1) AS after, count(*) FILTER (reason IS NOT NULL) AS malformed, count(*) FILTER (k > 1) AS duplicates, count(*) FILTER (reason IS NULL) AS repaired_cells, count(*) FILTER (reason = 'date') AS malformed_date, count(*) FILTER (reason = 'range') AS malformed_range FROM k)
SELECT symbol, date, {_r('close', 'close')}, before, after, malformed, duplicates, repaired_cells, malformed_date, malformed_range FROM k, t WHERE k = 1""")
def a25_observed(spark, sf_dir):
    """The repaired table as written, with the run's totals, which the writing job observed."""
    path = new_path(spark, "repaired")
    totals = clean.repair_into(clean.typed_cells(dirty_text(spark, sf_dir)), path)
    names = ("before", "after", "malformed", "duplicates", "repaired_cells", "malformed_date", "malformed_range")
    rows = spark.read.parquet(path).withColumns({c: F.lit(totals[c]).cast("long") for c in names})
    return rounded(rows, "close", *names)


@query("a23_integrity", f"""WITH {DIRTY}, d AS (SELECT *, CASE WHEN symbol % 6 <> 0 THEN close END AS adj, date < lag(date) OVER (PARTITION BY symbol ORDER BY seq) AS down FROM raw),
g AS (SELECT symbol, CASE WHEN count(adj) = 0 THEN 'adj,absent' ELSE 'absent' END AS missing_columns, count(date) AS n_dates, count(date) - count(DISTINCT date) AS duplicate_dates, count(*) FILTER (down) = 0 AS chronological, count(*) - count(date) AS blank_dates FROM d GROUP BY symbol)
SELECT *, concat_ws(',', 'columns', CASE WHEN duplicate_dates > 0 THEN 'duplicates' END, CASE WHEN NOT chronological THEN 'order' END, CASE WHEN blank_dates > 0 THEN 'blanks' END) AS problems, false AS ok FROM g""", dated=False)
def a23_integrity(spark, sf_dir):
    df = dirty(spark, sf_dir).withColumn("adj", F.when(F.col("symbol") % 6 != 0, F.col("close")))
    return clean.integrity_report(df, ("close", "adj", "absent"))


@query("l2_a26_archive", f"""WITH {DIRTY}, k AS (SELECT *, CASE WHEN date IS NOT NULL THEN row_number() OVER (PARTITION BY symbol ORDER BY date DESC NULLS LAST, seq DESC) END AS k FROM raw),
a AS (SELECT DISTINCT symbol, date FROM bars WHERE year(date) < 1997), j AS (SELECT k.*, coalesce(k.k > 30, false) AS old, a.date IS NOT NULL AS seen FROM k LEFT JOIN a ON a.symbol = k.symbol AND a.date = k.date),
n AS (SELECT *, old AND NOT seen AND row_number() OVER (PARTITION BY symbol, date, old ORDER BY seq DESC) = 1 AS new FROM j),
g AS (SELECT symbol, count(*) AS rows_seen, count(*) - count(date) AS undated, count(*) FILTER (old) AS candidates, count(*) FILTER (new) AS appended, CAST(coalesce(min(date) FILTER (new), min(date) FILTER (old)) AS VARCHAR) AS oldest, CAST(coalesce(max(date) FILTER (new), max(date) FILTER (old)) AS VARCHAR) AS newest FROM n GROUP BY symbol)
SELECT *, candidates - appended AS duplicates, candidates AS removed, CASE WHEN candidates = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN candidates = 0 THEN 'within the rolling window' WHEN appended > 0 THEN 'archived' ELSE 'archive had all' END AS reason FROM g""", dated=False)
def l2_archive(spark, sf_dir):
    old = bars(spark, sf_dir).where(F.year("date") < 1997).select("symbol", "date")
    out = clean.archive_report(dirty(spark, sf_dir), old)
    return out.withColumns({c: F.col(c).cast("string") for c in ("oldest", "newest")})


@query("l2_rolling_split", f"""WITH {DIRTY}, k AS (SELECT *, CASE WHEN date IS NOT NULL THEN row_number() OVER (PARTITION BY symbol ORDER BY date DESC NULLS LAST, seq DESC) END AS k FROM raw)
SELECT symbol, seq, 'keep' AS part FROM k WHERE k IS NULL OR k <= 30 UNION ALL SELECT symbol, max(seq), 'archive' FROM k WHERE k > 30 GROUP BY symbol, date""", dated=False)
def l2_split(spark, sf_dir):
    return clean.rolling_parts(dirty(spark, sf_dir)).select("symbol", "seq", "part")


@query("j3_append_upsert", f"""WITH {BARS}, a AS (SELECT symbol, date, close, 0 AS batch FROM bars WHERE day(date) % 3 <> 0), b AS (SELECT symbol, date, close + 1 AS close, 1 AS batch FROM bars WHERE day(date) % 2 = 0),
u AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY batch DESC) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
n AS (SELECT b.symbol, b.date FROM b LEFT JOIN a ON a.symbol = b.symbol AND a.date = b.date WHERE a.date IS NULL)
SELECT u.symbol, u.date, {_r('u.close', 'close')}, n.date IS NOT NULL AS appended FROM u LEFT JOIN n ON n.symbol = u.symbol AND n.date = u.date WHERE k = 1""")
def j3_append(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "date", "close")
    kept, fresh = b.where(F.dayofmonth("date") % 3 != 0), b.where(F.dayofmonth("date") % 2 == 0).withColumn("close", F.col("close") + 1)
    new = clean.unseen(fresh, kept, ["symbol", "date"]).select("symbol", "date", F.lit(True).alias("appended"))
    out = changes.upsert(kept, fresh, ["symbol", "date"], ["close"]).join(new, ["symbol", "date"], "left").withColumn("appended", F.coalesce("appended", F.lit(False)))
    return rounded(out, "close", "appended")


@query("a14_a30_f8_new_data", f"""WITH {BARS}, c AS (SELECT symbol, max(date) AS last_date FROM bars WHERE date <= DATE '2000-06-30' AND symbol % 7 <> 0 GROUP BY symbol)
SELECT bars.symbol, CAST(max(bars.date) AS VARCHAR) AS last_date, DATE '2002-01-01' - max(bars.date) AS gap_days, DATE '2002-01-01' > max(bars.date) AS expect_new,
  count(*) FILTER (c.last_date IS NULL OR bars.date > c.last_date) AS n_newer FROM bars LEFT JOIN c USING (symbol) GROUP BY bars.symbol""", dated=False)
def a14_new(spark, sf_dir):
    b = bars(spark, sf_dir)
    marks = clean.last_dates(b.where("date <= date '2000-06-30' and symbol % 7 <> 0"))
    newer = clean.newer_than(b, marks).groupBy("symbol").agg(F.count("*").alias("n_newer"))
    out = clean.detect_new(b, F.lit("2002-01-01").cast("date")).join(newer, "symbol", "left")
    return out.select("symbol", F.col("last_date").cast("string").alias("last_date"), F.col("gap_days").cast("long").alias("gap_days"), "expect_new", F.coalesce("n_newer", F.lit(0)).alias("n_newer"))


_OPEN = "(predicted = 0 OR forecast IS NULL)"
_ELIGIBLE = f"""WITH {BARS}, p AS (SELECT symbol, date, row_number() OVER ({_W}) - 1 AS pos FROM bars), e0 AS (SELECT *, (pos % 3 = 0 AND pos > symbol % 40)::INT AS predicted, CASE WHEN pos % 9 <> 0 THEN 1.0 END AS forecast FROM p),
e AS (SELECT *, greatest(coalesce(min(pos) FILTER (predicted = 1) OVER (PARTITION BY symbol), 20), 20) AS mark FROM e0)"""


@query("f7_l3_w24_eligible", f"""{_ELIGIBLE} SELECT symbol, date, pos, 'default' AS mode FROM e WHERE pos > mark AND {_OPEN} UNION ALL SELECT symbol, max(date), max(pos), 'latest_only' FROM e WHERE pos > mark AND {_OPEN} GROUP BY symbol
UNION ALL SELECT symbol, date, pos, 'all_eligible' FROM e WHERE pos > 20 AND {_OPEN} UNION ALL SELECT symbol, date, pos, 'force_all' FROM e WHERE pos > 20 UNION ALL SELECT symbol, date, pos, 'refresh' FROM e WHERE pos > mark""")
def f7_eligible(spark, sf_dir):
    from quantloom.operators.labels import positions

    p = positions(bars(spark, sf_dir))
    p = p.withColumns({"predicted": ((F.col("pos") % 3 == 0) & (F.col("pos") > F.col("symbol") % 40)).cast("int"), "forecast": F.when(F.col("pos") % 9 != 0, 1.0)})
    out = clean.eligible_modes(p, ("default", "latest_only", "all_eligible", "force_all", "refresh"))
    return rounded(out.withColumn("pos", F.col("pos").cast("long")), "pos", "mode")


@query("f9_safe_market_date", """SELECT event_id, CAST(d AS VARCHAR) AS safe_date, CAST(d - CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS VARCHAR) AS safe_weekday
FROM (SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) - CASE WHEN hour(ts + INTERVAL 330 MINUTE) < 16 THEN 1 ELSE 0 END AS d FROM events)""", dated=False)
def f9_market_date(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", scalars.safe_market_date(ts).cast("string").alias("safe_date"), scalars.safe_market_date(ts, weekends=True).cast("string").alias("safe_weekday"))


#: A sheet is a priority and a block of order keys, so sheets grow in number, not in size. Every fifth block is new, every fifth gone, every fifth as it was.
SNAPSHOTS = """n AS (SELECT o_orderpriority || '-' || o_orderkey // 4000 AS sheet, row_number() OVER (PARTITION BY o_orderpriority, o_orderkey // 4000 ORDER BY o_orderkey) AS row_no, o_orderkey // 4000 % 5 AS kind, * FROM orders),
prev AS (SELECT sheet, row_no, md5(o_orderstatus || '|' || CAST(CAST(o_totalprice * 100 AS BIGINT) AS VARCHAR)) AS h FROM n WHERE kind <> 1 AND (o_orderkey % 10 <> 0 OR kind = 3)),
cur AS (SELECT sheet, row_no, md5(o_orderstatus || '|' || CAST(CAST((o_totalprice + CASE WHEN o_orderkey % 7 = 0 AND kind <> 3 THEN 1 ELSE 0 END) * 100 AS BIGINT) AS VARCHAR)) AS h FROM n WHERE kind <> 2)"""


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    n = table(spark, sf_dir, "orders").withColumns({"sheet": F.concat("o_orderpriority", F.lit("-"), F.floor(k / 4000)), "kind": F.floor(k / 4000) % 5})
    n = n.withColumn("row_no", F.row_number().over(Window.partitionBy("sheet").orderBy("o_orderkey")))
    h = lambda price: F.md5(F.concat_ws("|", "o_orderstatus", F.round(price * 100).cast("long").cast("string")))
    prev = n.where((F.col("kind") != 1) & ((k % 10 != 0) | (F.col("kind") == 3))).select("sheet", "row_no", h(F.col("o_totalprice")).alias("row_hash"))
    return prev, n.where("kind <> 2").select("sheet", "row_no", h(F.col("o_totalprice") + F.when((k % 7 == 0) & (F.col("kind") != 3), 1).otherwise(0)).alias("row_hash"))


_DIFF = f"""WITH {SNAPSHOTS}, d AS (SELECT sheet, count(*) FILTER (p.h IS NULL) AS added_rows, count(*) FILTER (p.h <> c.h) AS modified_rows, count(*) FILTER (c.h IS NULL) AS removed_rows,
  CASE WHEN count(p.h) = 0 THEN 'sheet_added' WHEN count(c.h) = 0 THEN 'sheet_removed' WHEN count(*) FILTER (p.h IS NULL OR p.h <> c.h) > 0 THEN 'updated' END AS change FROM prev p FULL JOIN cur c USING (sheet, row_no) GROUP BY sheet)"""


@query("j9_u3_snapshot_diff", f"{_DIFF} SELECT * FROM d WHERE change IS NOT NULL", dated=False)
def j9_diff(spark, sf_dir):
    return changes.diff_snapshots(*snapshots(spark, sf_dir))


@query("j9_f11_snapshot_diff", f"{_DIFF} SELECT * FROM d WHERE change IN ('updated', 'sheet_added')", dated=False)
def f11_actionable(spark, sf_dir):
    return changes.actionable(changes.diff_snapshots(*snapshots(spark, sf_dir)))


@query("j9_a29_kept_trees", f"{_DIFF} SELECT * FROM d WHERE change IS NOT NULL", dated=False)
def j9_kept(spark, sf_dir):
    """The snapshot before was written with its hash tree; its rows are read under unequal blocks only."""
    prev, cur = snapshots(spark, sf_dir)
    kept = cut(prev, "snapshot")
    return changes.diff_snapshots(kept, cut(cur, "snapshot"), cut(changes.hash_tree(kept, 64), "tree"), fan=64)


@query("a29_sheet_hash", f"WITH {SNAPSHOTS} SELECT sheet, sha256(string_agg(row_no || ':' || h, chr(10) ORDER BY row_no)) AS sheet_hash FROM cur GROUP BY sheet", dated=False)
def a29_hash(spark, sf_dir):
    return changes.sheet_hash(snapshots(spark, sf_dir)[1])


@query("j9_a29_hash_tree", f"""WITH {SNAPSHOTS}, s AS (SELECT 'cur' AS side, * FROM cur UNION ALL SELECT 'prev', * FROM prev),
b AS (SELECT side, sheet, row_no // 16 AS block, count(*) AS n, sha256(string_agg(row_no || ':' || h, chr(10) ORDER BY row_no)) AS h FROM s GROUP BY 1, 2, 3),
g AS (SELECT side, sheet, block // 16 AS grp, sum(n) AS n, sha256(string_agg(block || ':' || h, chr(10) ORDER BY block)) AS h FROM b GROUP BY 1, 2, 3),
t AS (SELECT side, sheet, sum(n)::BIGINT AS n, sha256(string_agg(grp || ':' || h, chr(10) ORDER BY grp)) AS sheet_hash FROM g GROUP BY 1, 2)
SELECT coalesce(c.sheet, p.sheet) AS sheet, c.n AS rows_now, p.n AS rows_before, c.sheet_hash, c.sheet_hash IS NOT DISTINCT FROM p.sheet_hash AS same,
  (SELECT count(*) FROM (SELECT sheet, block FROM b GROUP BY sheet, block HAVING min(h) <> max(h) OR count(*) = 1) u WHERE u.sheet = coalesce(c.sheet, p.sheet)) AS unequal_blocks
FROM (SELECT * FROM t WHERE side = 'cur') c FULL JOIN (SELECT * FROM t WHERE side = 'prev') p USING (sheet)""", dated=False)
def j9_tree(spark, sf_dir):
    """Roots of both snapshots' trees of 16 rows a block and 16 blocks a group, and how many blocks differ."""
    before, after = (changes.hash_tree(rows, 16) for rows in snapshots(spark, sf_dir))
    old = changes.tree_hash(before, 16).select("sheet", F.col("n").alias("rows_before"), F.col("sheet_hash").alias("old_hash"))
    n = changes.unequal_blocks(before, after, 16).groupBy("sheet").agg(F.count("*").alias("unequal_blocks"))
    out = changes.tree_hash(after, 16).withColumnRenamed("n", "rows_now").join(old, "sheet", "full").join(n, "sheet", "left")
    same = F.col("sheet_hash").eqNullSafe(F.col("old_hash"))
    return out.select("sheet", "rows_now", "rows_before", "sheet_hash", same.alias("same"), F.coalesce("unequal_blocks", F.lit(0).cast("long")).alias("unequal_blocks"))


@query("j6_j15_merge_changed_cells", f"""WITH {BARS}, n AS (SELECT symbol, row_number() OVER ({_W}) AS row_no, close FROM bars)
SELECT symbol, row_no, 'forecast' AS "column", CAST(row_no * 2 AS VARCHAR) AS value FROM n WHERE row_no % 4 = 0 UNION ALL SELECT symbol, row_no, 'predicted', '1' FROM n WHERE row_no % 4 = 0 AND row_no % 8 <> 0""", dated=False)
def j6_cells(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("date")
    rows = bars(spark, sf_dir).select("symbol", F.row_number().over(w).cast("long").alias("row_no")).withColumns({"predicted": (F.col("row_no") % 8 == 0).cast("int"), "forecast": F.lit(None).cast("long")})
    pred = rows.where("row_no % 4 = 0").select("symbol", "row_no", (F.col("row_no") * 2).alias("forecast"))
    return changes.changed_cells(rows, changes.merge_predictions(rows, pred), ["predicted", "forecast"])


@query("j10_context", f"""WITH {BARS}, live AS (SELECT symbol, date FROM bars WHERE date >= DATE '2000-06-01'), f AS (SELECT symbol, min(date) AS d FROM live GROUP BY symbol)
SELECT symbol, date, 'live' AS source FROM live UNION ALL SELECT bars.symbol, bars.date, 'history' FROM bars JOIN f USING (symbol) WHERE bars.date < f.d""")
def j10_context(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "date")
    return rounded(changes.with_context(b.where("date >= date '2000-06-01'"), b), "source")


STATEMENTS = """st AS (SELECT o_custkey % 20 AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_end, round(sum(o_totalprice), 2) AS revenue, round(0.1 * sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS net_income,
  round(2 * avg(o_totalprice), 2) AS equity, round(max(o_totalprice), 2) AS debt, count(*) AS n FROM orders GROUP BY 1, 2)"""


def statements(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    df = o.groupBy((F.col("o_custkey") % 20).alias("ticker"), F.trunc("o_orderdate", "quarter").alias("quarter_end")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(0.1 * F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)), 2).alias("net_income"), F.round(2 * F.avg("o_totalprice"), 2).alias("equity"), F.round(F.max("o_totalprice"), 2).alias("debt"), F.count("*").alias("n"))
    return df.withColumns({"net_income_common": F.col("revenue") * 0.05, "assets": F.col("equity") + F.col("debt"), "op_cashflow": F.when(F.col("n") % 5 != 0, F.col("revenue") * 0.2), "capex": -F.col("debt")})


@query("p15_p18_a21_fundamentals", f"""WITH {STATEMENTS}, y AS (SELECT *, lag(revenue, 4) OVER (PARTITION BY ticker ORDER BY quarter_end) AS r4, row_number() OVER (PARTITION BY ticker ORDER BY quarter_end DESC) AS rank FROM st)
SELECT ticker, year(quarter_end) || 'Q' || quarter(quarter_end) AS quarter, {_r('coalesce(nullif(net_income, 0), revenue * 0.05) / nullif(revenue, 0)', 'net_margin')}, {_r('debt / nullif(equity, 0)', 'debt_to_equity')}, {_r('coalesce(nullif(net_income, 0), revenue * 0.05) / nullif(equity, 0)', 'roe', 3)},
  {_r('revenue / nullif(equity + debt, 0)', 'asset_turnover', 3)}, {_r('CASE WHEN n % 5 <> 0 THEN revenue * 0.2 END - debt', 'free_cash_flow', 1)}, {_r('(revenue - r4) / nullif(abs(r4), 0)', 'revenue_yoy')}, rank FROM y WHERE rank <= 4""", dated=False)
def p17_fundamentals(spark, sf_dir):
    df = fundamentals.last_quarters(fundamentals.growth(fundamentals.quarter_financials(statements(spark, sf_dir))))
    digits = {"net_margin": 4, "debt_to_equity": 4, "roe": 3, "asset_turnover": 3, "free_cash_flow": 1, "revenue_yoy": 4}
    return df.select("ticker", "quarter", *[(F.round(F.col(c) + 3e-7, d) + 0.0).alias(c) for c, d in digits.items()], F.col("rank").cast("long").alias("rank"))


@query("a15_next_event", """SELECT o_custkey % 20 AS ticker, CAST(min(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) > DATE '1998-03-01') AS VARCHAR) AS next_date,
  (min(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) > DATE '1998-03-01')) - DATE '1998-03-01' AS days_to,
  coalesce((min(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) > DATE '1998-03-01')) - DATE '1998-03-01' BETWEEN 0 AND 5, false)::INT AS in_window FROM orders GROUP BY 1""", dated=False)
def a15_event(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("ticker"), F.to_date("o_orderdate").alias("event_date"))
    out = fundamentals.next_event(e, F.lit("1998-03-01").cast("date"))
    return out.select("ticker", F.col("next_date").cast("string").alias("next_date"), F.col("days_to").cast("long").alias("days_to"), "in_window")


@query("w31_sector_rank", """WITH s AS (SELECT p_partkey AS ticker, p_brand AS sector, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS pe FROM part)
SELECT ticker, round(CASE WHEN pe IS NOT NULL THEN (rank() OVER (PARTITION BY sector ORDER BY pe NULLS LAST) + (count(*) OVER (PARTITION BY sector, pe) - 1) / 2.0) / count(pe) OVER (PARTITION BY sector) END + 3e-7, 4) AS pe_sector_rank FROM s""", dated=False)
def w31_rank(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_brand").alias("sector"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).alias("pe"))
    return rounded(fundamentals.sector_rank(s), "pe_sector_rank", keys=("ticker",))


_T = f"OVER ({_W} ROWS BETWEEN {{}} PRECEDING AND CURRENT ROW)"


def _full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {_T.format(n - 1)} = {n} THEN {agg} {_T.format(n - 1)} END"


def _cross(a: str, b: str, up: str, down: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN '' WHEN {a} > {b} THEN '{up}' WHEN {a} < {b} THEN '{down}' ELSE 'neutral' END"


def _bin(c: str) -> str:
    p = lambda k: f"CASE WHEN {c}_n >= 30 THEN {c}_p[{k + 1}] ELSE {(30.0, 50.0, 70.0)[k]} END"
    return f"CASE WHEN {c} IS NULL THEN '' WHEN {c} > {p(2)} THEN 'highly overbought' WHEN {c} > {p(1)} THEN 'slightly overbought' WHEN {c} < {p(0)} THEN 'highly oversold' WHEN {c} < {p(1)} THEN 'slightly oversold' ELSE 'neutral' END"


_STATES = {
    "sma_5_20": _cross("s5", "s20", "bullish", "bearish"), "sma_20_50": _cross("s20", "s50", "strong bullish", "strong bearish"), "ema_12_26": _cross("e12", "e26", "bullish", "bearish"), "ema_26_50": _cross("e26", "e50", "long-term bullish", "long-term bearish"),
    "bb_trend_state": "CASE WHEN pb IS NULL THEN '' WHEN pb > 0.6 THEN 'bullish' WHEN pb < 0.4 THEN 'bearish' ELSE 'neutral' END",
    "bb_overbought_oversold": "CASE WHEN pb IS NULL THEN '' WHEN pb >= 1.0 THEN 'overbought' WHEN pb <= 0.0 THEN 'oversold' ELSE 'neutral' END",
    "bb_volatility_state": "CASE WHEN bw IS NULL THEN '' WHEN bw_n < 30 THEN 'normal volatility' WHEN bw > bw_p[3] THEN 'high volatility' WHEN bw < bw_p[1] THEN 'low volatility' ELSE 'normal volatility' END",
    "rsi_indicator_7": _bin("rsi_7"), "rsi_indicator_14": _bin("rsi_14"),
}


def _decision_sql(source: str) -> str:
    """All eleven columns over bars of a fixture."""
    rsi = lambda n: f"100 - 100 / (1 + ({_full('avg(gain)', 'gain', n)}) / nullif({_full('avg(loss)', 'loss', n)}, 0)) AS rsi_{n}"
    cuts = lambda c: f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS {c}_p, count({c}) AS {c}_n"
    return f"""WITH RECURSIVE {source}, {EMA_ROWS}, d AS (SELECT *, close - lag(close) OVER ({_W}) AS d FROM num), g AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss FROM d),
i AS (SELECT *, {rsi(7)}, {rsi(14)}, {', '.join(f"{_full('avg(close)', 'close', k)} AS s{k}" for k in (5, 20, 50))}, {_full('stddev_samp(close)', 'close', 20)} AS sd FROM g),
b AS (SELECT i.*, e12.y AS e12, e26.y AS e26, e50.y AS e50, (close - (s20 - 2 * sd)) / nullif(4 * sd, 0) AS pb, 4 * sd / nullif(s20, 0) AS bw FROM i JOIN e12 USING (symbol, n) JOIN e26 USING (symbol, n) JOIN e50 USING (symbol, n)),
q AS (SELECT symbol, {cuts('rsi_7')}, {cuts('rsi_14')}, {cuts('bw')} FROM b GROUP BY symbol),
s AS (SELECT b.symbol, b.date, round(rsi_7 + 3e-7, 2) + 0.0::DOUBLE AS rsi_7, {', '.join(f'{x} AS {c}' for c, x in _STATES.items())} FROM b JOIN q USING (symbol))
SELECT *, array_to_string(list_filter([bb_trend_state, bb_overbought_oversold, bb_volatility_state], lambda x: x <> ''), ' | ') AS bb_indicator FROM s"""


@query("w26_w28_a16_decision_states", _decision_sql(DEEP))
def w26_states(spark, sf_dir):
    return _decided(deep_bars(spark, sf_dir))


@query("w29_decision_table", _decision_sql(BARS))
def w29_table(spark, sf_dir):
    return _decided(bars(spark, sf_dir))


@query("a16_pooled_thresholds", f"""WITH {DEEP}, live AS (SELECT symbol, close, volume FROM bars WHERE date >= DATE '1998-08-01'), old AS (SELECT symbol, close, volume FROM bars WHERE date < DATE '1992-03-01'),
b AS (SELECT * FROM live UNION ALL SELECT * FROM old), t AS (SELECT symbol, 'pooled' AS side, * EXCLUDE symbol FROM b UNION ALL SELECT symbol, 'live', * EXCLUDE symbol FROM live WHERE symbol <> 0 OR volume > 1000000)
SELECT symbol, side, {', '.join(f"count({c}) >= 30 AS {c}_enough, " + ', '.join(_r(f"CASE WHEN count({c}) >= 30 THEN quantile_cont({c}, {q / 100}) ELSE {d}.0 END", f"{c}_p{q}") for q, d in ((25, 30), (50, 50), (75, 70))) for c in ("close", "volume"))} FROM t GROUP BY symbol, side""", dated=False)
def a16_pooled(spark, sf_dir):
    """Thresholds over live and archived rows together, and over the live ones alone, of which a symbol has none."""
    b = deep_bars(spark, sf_dir)
    live, old = b.where("date >= date '1998-08-01'"), b.where("date < date '1992-03-01'")
    both = decision.thresholds(live, ["close", "volume"], old).withColumn("side", F.lit("pooled"))
    out = both.unionByName(decision.thresholds(live.where("symbol <> 0 or volume > 1000000"), ["close", "volume"]).withColumn("side", F.lit("live")))
    return rounded(out, *[f"{c}_{x}" for c in ("close", "volume") for x in ("enough", "p25", "p50", "p75")], keys=("symbol", "side"))


def _decided(df: DataFrame) -> DataFrame:
    out = decision.decision_features(df.withColumn("close", F.col("close")))
    return rounded(out.drop("open", "high", "low", "close", "volume", "rsi_7"), *_STATES, "bb_indicator").join(
        out.select("symbol", F.col("date").cast("string").alias("date"), (F.round(F.col("rsi_7") + 3e-7, 2) + 0.0).alias("rsi_7")), ["symbol", "date"])


@query("a24_liveness", f"""WITH {BARS}, k AS (SELECT *, CASE WHEN symbol % 4 <> 0 OR year(date) < 1999 THEN close END AS live, CASE WHEN symbol % 3 = 0 AND year(date) < 1997 THEN 1.0 END AS y, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars),
g AS (SELECT symbol, count(*) FILTER (k <= 5) AS n_rows, 'absent' AS missing_columns, CASE WHEN count(live) FILTER (k <= 5) = 0 THEN 'live' ELSE '' END AS dead_columns, count(y) > 0 AS has_labels FROM k GROUP BY symbol) SELECT *, false AS ok FROM g""", dated=False)
def a24_liveness(spark, sf_dir):
    b = bars(spark, sf_dir).withColumns({"live": F.when((F.col("symbol") % 4 != 0) | (F.year("date") < 1999), F.col("close")), "y_logret_h1": F.when((F.col("symbol") % 3 == 0) & (F.year("date") < 1997), 1.0)})
    return clean.liveness_report(b, ["open", "live", "absent"], ("y_logret_h1", "y_logret_h2"))


@query("a27_status", f"""WITH {BARS}, s AS (SELECT symbol, count(*) AS fetched, sum((year(date) > 2000 AND symbol % 3 <> 0)::INT) AS fresh, sum((symbol % 10 = 7)::INT) AS failed, sum((symbol % 10 = 4)::INT) AS skipped FROM bars GROUP BY symbol),
e AS (SELECT symbol, fetched, fresh, CASE WHEN failed > 0 THEN 'error' WHEN skipped > 0 THEN 'skipped' WHEN fresh > 0 THEN 'updated' WHEN fetched > 0 THEN 'duplicate_only' ELSE 'no_new_data' END AS status FROM s)
SELECT symbol::VARCHAR AS symbol, fetched, fresh::BIGINT AS fresh, status FROM e UNION ALL SELECT 'run', sum(fetched)::BIGINT, sum(fresh)::BIGINT, CASE WHEN count(*) FILTER (status = 'error') = count(*) THEN 'error' WHEN count(*) FILTER (status = 'error') > 0 THEN 'partial_error' WHEN sum(fresh) > 0 THEN 'ok' ELSE 'no_new_data' END FROM e""", dated=False)
def a27_status(spark, sf_dir):
    flag = lambda c: c.cast("int")
    df = bars(spark, sf_dir).select("symbol", F.lit(1).alias("fetched"), flag((F.year("date") > 2000) & (F.col("symbol") % 3 != 0)).alias("fresh"), flag(F.col("symbol") % 10 == 7).alias("failed"), flag(F.col("symbol") % 10 == 4).alias("skipped"))
    return clean.status_rollup(df).withColumn("symbol", F.coalesce(F.col("symbol").cast("string"), F.lit("run")))


@query("a27_forecast_run", f"""WITH {BARS}, c AS (SELECT symbol, count(*) FILTER (symbol % 8 <> 1 OR day(date) = 1) AS n_rows, count(*) FILTER (day(date) = 3) AS n_eligible, CASE WHEN symbol % 5 = 2 THEN 0 ELSE count(*) FILTER (day(date) = 3) END AS n_written FROM bars GROUP BY symbol),
s AS (SELECT *, CASE WHEN n_rows <= 20 THEN 'no_valid_start_point' WHEN n_written > 0 THEN 'ok' ELSE 'no_new_data' END AS status FROM c)
SELECT symbol::VARCHAR AS symbol, n_rows, n_eligible, n_written, status FROM s UNION ALL SELECT 'run', sum(n_rows)::BIGINT, sum(n_eligible)::BIGINT, sum(n_written)::BIGINT, CASE WHEN count(*) FILTER (status = 'ok') > 0 THEN 'ok' WHEN count(*) FILTER (status = 'no_valid_start_point') = count(*) THEN 'no_valid_start_point' ELSE 'no_new_data' END FROM s""", dated=False)
def a27_forecast_run(spark, sf_dir):
    s, d = F.col("symbol"), F.dayofmonth("date")
    c = bars(spark, sf_dir).groupBy("symbol").agg(F.count_if((s % 8 != 1) | (d == 1)).alias("n_rows"), F.count_if(d == 3).alias("n_eligible"))
    c = c.withColumns({"n_written": F.when(s % 5 == 2, F.lit(0).cast("long")).otherwise(F.col("n_eligible")), "start": F.lit(19)})
    return clean.forecast_rollup(c).withColumn("symbol", F.coalesce(F.col("symbol").cast("string"), F.lit("run")))


@query("a28_dataset_summary", f"""WITH {BARS}, p AS (SELECT *, CASE WHEN symbol % 5 = 0 THEN 'replay' WHEN year(date) > 2000 THEN 'validation' WHEN symbol % 7 <> 0 THEN 'train' ELSE 'replay' END AS part FROM bars),
g AS (SELECT symbol, count(*) AS n_rows, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'validation') AS n_validation, count(*) FILTER (part = 'replay') AS n_replay, CAST(max(date) AS VARCHAR) AS last_date FROM p GROUP BY symbol)
SELECT *, CASE WHEN n_train + n_validation = 0 THEN 'no new rows' WHEN n_train < 1 THEN 'too few rows' END AS skip_reason FROM g""", dated=False)
def a28_summary(spark, sf_dir):
    s = F.col("symbol")
    df = bars(spark, sf_dir).withColumn("part", F.when(s % 5 == 0, "replay").when(F.year("date") > 2000, "validation").when(s % 7 != 0, "train").otherwise("replay"))
    return clean.dataset_summary(df).withColumn("last_date", F.col("last_date").cast("string"))
