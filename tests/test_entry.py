"""Registered queries against their SQL on the smallest tables, where those are at hand."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith(("op", "pipeline"))]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["sma_returns", "w5_ema_w2_macd", "a13_sentiment_a9_a12_j11", "a25_a19_repair", "a7_forecast_metrics_a3_a4_a5", "j9_f11_snapshot_diff", "s7_s14_s15_u4_inbox", "x4_stream_changes", "x2_x3_daily_counts", "w25_indicator_table", "w29_decision_table", "p18_flat_fundamentals", "a8_validation_score", "f7_l3_w24_eligible", "l2_a26_archive", "t9_open_override", "w32_trailing_stats"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "documents", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    a, b = entry.queries()[name](spark, DIR).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    text = lambda df: sorted(",".join("" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in df[sorted(df)].itertuples(index=False))
    assert text(a) == text(b)
