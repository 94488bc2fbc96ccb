import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars, schemas
from quantloom.operators import changes, clean, text
from quantloom.sources import readers, sinks
from quantloom.streaming import flows


def test_headers():
    found, missing = schemas.resolve_schema(["Date_str", "Open_INFY.NS", "high INFY", "LOW", "Close", "Volume_x"], "INFY")
    assert found["Open"] == "Open_INFY.NS" and found["High"] == "high INFY" and found["Volume"] == "Volume_x" and found["Date"] == "Date_str" and not missing
    assert schemas.clean_headers(["a", "", "a", " "]) == ["a", "Column_2", "a_2"] and schemas.clean_headers(["", " "]) == []
    assert schemas.resolve_schema(["Time", "Open A", "Open B"])[0] == {"Date": "Time"} and schemas.find_close(["x", "close_INFY"]) == "close_INFY" and schemas.find_close(["x"]) is None
    assert schemas.resolve_schema(["open_x", "OPEN", "Open"])[0]["Open"] == "OPEN"
    with pytest.raises(schemas.FeatureError):
        schemas.assert_no_labels(["rsi", "y_logret_h3"])
    with pytest.raises(schemas.FeatureError):
        schemas.find_ohlcv(["Date", "Close"])


def test_scalars(spark):
    df = spark.createDataFrame([("1,234.5", "05/03/2024"), ("nan", "2024-03-05"), ("inf", "soon"), (None, None)], "n string, d string")
    rows = df.select(scalars.to_number(F.col("n")).alias("n"), scalars.parse_date(F.col("d")).alias("d"), scalars.clean_cell(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in spark.sql("select * from values ('TRUE'), ('nan'), ('x') as t(b)").select(scalars.clean_cell(F.col("b"), "text").alias("c")).collect()] == ["True", "", "x"]
    assert [r["n"] for r in rows] == [1234.5, None, None, None]
    assert [r["d"] for r in rows] == [dt.date(2024, 3, 5), dt.date(2024, 3, 5), None, None] and [r["c"] for r in rows] == ["1,234.5", "", "", ""]
    h = spark.sql("select 'a ' x, '' y").select(scalars.row_hash(F.col("x"), F.col("y")).alias("h1"), scalars.row_hash(F.col("x")).alias("h2")).first()
    assert h["h1"] == h["h2"]


def test_repair_keeps_the_newer_duplicate(spark):
    rows = [("s", 1, "2024-01-02", 5.0, 4.0), ("s", 2, "2024-01-01", 5.0, 4.0), ("s", 3, "2024-01-03", 1.0, 4.0), ("s", 4, "2024-01-02", 6.0, 4.0)]
    df = spark.createDataFrame(rows, "symbol string, seq int, date string, high double, low double").withColumns({"open": F.lit(4.0), "close": F.col("high"), "volume": F.lit(1.0)})
    good, report = clean.repair(clean.typed(df))
    assert sorted((r["seq"]) for r in good.collect()) == [2, 4]
    r = report.first()
    assert (r["before"], r["after"], r["malformed"], r["duplicates"], r["was_sorted"], r["repaired_cells"], r["status"]) == (4, 2, 1, 1, False, 0, "repaired")
    assert clean.repair(clean.typed(df.where("seq = 3")))[1].first()["status"] == "error"
    with pytest.raises(schemas.FeatureError):
        clean.valid_ohlcv(clean.typed(df.where("seq = 3")), check=True)


def test_snapshot_diff(spark):
    make = lambda rows: spark.createDataFrame(rows, "sheet string, row_no int, row_hash string")
    before = make([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "q"), ("c", 2, "r")])
    after = make([("a", 1, "x"), ("a", 2, "Y"), ("a", 3, "n"), ("d", 1, "m"), ("c", 1, "q")])
    out = {r["sheet"]: (r["change"], r["added_rows"], r["modified_rows"]) for r in changes.diff_snapshots(before, after).collect()}
    assert out == {"a": ("updated", 1, 1), "b": ("sheet_removed", 0, 0), "d": ("sheet_added", 1, 0)}
    assert changes.diff_snapshots(before, before).count() == 0


def test_tagging_respects_boundaries(spark):
    al = spark.createDataFrame([("INFY", "infosys"), ("INFY", "infy"), ("MM", "m & m"), ("MM", "mahindra motors")], "ticker string, term string")
    posts = spark.createDataFrame([(1, "Buy $INFY now"), (2, "infosystems"), (3, "the M & M plant and Infosys"), (4, ""), (5, None)], "id int, body string")
    got = sorted((r["id"], r["ticker"]) for r in text.tag_entities(posts, al, "id", "body").collect())
    assert got == [(1, "INFY"), (2, "GENERAL"), (3, "INFY"), (3, "MM"), (4, "GENERAL"), (5, "GENERAL")]
    assert text.tag_entities(posts, al, "id", "body", None).count() == 3


def test_scorer_hook_and_lexicon(spark):
    df = spark.createDataFrame([("good good bad",), (None,)], "t string")

    def scorer():
        return lambda texts: pd.DataFrame({"positive": [float(len(t)) for t in texts], "negative": 0.0, "neutral": 0.0, "polarity": 1.0})

    assert sorted(r["positive"] for r in text.score_text(df, "t", scorer).collect()) == [0.0, 13.0]
    assert text.lexicon_scores(df, "t", ["good"], ["bad"]).where("t is not null").first()["polarity"] == pytest.approx(1 / 3)


def test_sources(spark, tmp_path):
    assert readers.read_staged(spark, str(tmp_path / "none"), "a int").count() == 0
    listing = {"data": {"children": [{"data": {"title": "t", "selftext": "b", "score": 3, "num_comments": 1, "created_utc": 1700000000.0, "permalink": "/r/x", "subreddit": "s"}}, {"data": {"title": "old", "created_utc": 1.0, "permalink": "/o"}}]}}
    (tmp_path / "l.json").write_text(json.dumps(listing))
    rows = readers.posts_from_listing(spark, str(tmp_path / "l.json"), F.lit("2020-01-01").cast("timestamp")).collect()
    assert [r["url"] for r in rows] == ["https://www.reddit.com/r/x"]
    items = spark.createDataFrame([(json.dumps({"content": {"title": "a", "canonicalUrl": {"url": "u"}, "provider": {"displayName": "p"}, "pubDate": "2024-01-02T03:04:05Z"}}),), (json.dumps({"title": "b", "link": "v", "publisher": "q", "providerPublishTime": 1700000000}),), (json.dumps({"title": "c"}),)], "raw string")
    assert sorted((r["title"], r["url"], r["source"]) for r in readers.news_from_items(items).collect()) == [("a", "u", "p"), ("b", "v", "q")]
    (tmp_path / "a.json").write_text(json.dumps({"X": {"name": "Ex", "sector": "s", "aliases": ["ex", "Ex"]}}))
    assert sorted(r["term"] for r in readers.alias_dim(spark, str(tmp_path / "a.json")).collect()) == ["Ex", "ex"]
    assert readers.alias_dim(spark, str(tmp_path / "b.json")).count() == 0


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("k", 1), ("m", 1)], "key string, v int")
    root = str(tmp_path / "t")
    assert sinks.merge_stage(a, root, ["key"], ["v"]) == 2
    assert sinks.merge_stage(spark.createDataFrame([("k", 5), ("k", 3)], "key string, v int"), root, ["key"], ["v"]) == 2
    assert {r["key"]: r["v"] for r in sinks.current(spark, root).collect()} == {"k": 5, "m": 1}
    assert sinks.vacuum(spark, root) == 1 and sinks.current(spark, root).count() == 2


def test_a_merge_rewrites_the_parts_that_it_touches(spark, tmp_path):
    root, month = str(tmp_path / "t"), F.date_format("date", "yyyy-MM")
    make = lambda rows: spark.createDataFrame(rows, "symbol string, date date, close double")
    sinks.merge_stage(make([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 2, 1), 1.0), ("a", None, 1.0)]), root, ["symbol", "date"], ["close"], month)
    first = sinks._current(spark, root)
    assert sinks.merge_stage(make([("a", dt.date(2024, 2, 1), 5.0), ("b", dt.date(2024, 2, 2), 5.0)]), root, ["symbol", "date"], ["close"], month) == 2
    second = sinks._current(spark, root)
    assert set(first) == set(second) == {"2024-01", "2024-02", "none"} and [p for p in first if first[p] != second[p]] == ["2024-02"]
    assert sorted((str(r["date"]), r["close"]) for r in sinks.current(spark, root).collect()) == [("2024-01-01", 1.0), ("2024-02-01", 5.0), ("2024-02-02", 5.0), ("None", 1.0)]
    assert sinks.merge_stage(make([]), root, ["symbol", "date"], ["close"], month) == 0


def test_a_failing_sink_loses_nothing(spark, tmp_path):
    root, got = str(tmp_path / "p"), []
    make = lambda *rows: spark.createDataFrame(rows, "key string, v int")
    assert sinks.drain(spark, root, lambda df: 0) is None and sinks.stage(make(("k", 1), ("m", 1)), root) and not sinks.stage(make(("k", 9)).limit(0), root)
    waits = sinks.collect(spark, root, lambda: make(("k", 2), ("n", 2)), lambda df: 0, keys=["key"], order=["v"])
    assert sorted(map(tuple, waits.collect())) == [("k", 2), ("m", 1), ("n", 2)]
    # Off, what waits is still drained, once; a batch staged while the sink writes waits on.

    def sink(df):
        rows = [tuple(r) for r in df.collect()]
        sinks.stage(make(("late", 3)), root, replace=False)
        got.extend(rows)
        return len(rows)

    assert [tuple(r) for r in sinks.collect(spark, root, lambda: 1 / 0, sink, enabled=False, keys=["key"], order=["v"]).collect()] == [("late", 3)]
    assert sorted(got) == [("k", 2), ("m", 1), ("n", 2)]
    assert sinks.drain(spark, root, lambda df: df.count()) == 1 and sinks.pending(spark, root) is None
    assert sinks.stage(make(("x", 1)), root) and sinks.stage(make(("y", 1)), root) and [tuple(r) for r in sinks.pending(spark, root).collect()] == [("y", 1)]


def test_streams(spark, tmp_path):
    def feed(name, frames, schema):
        for k, rows in enumerate(frames):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / f"{k}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))

    schema, day = "symbol string, date date, close double, ts timestamp", dt.date(2024, 1, 1)
    bars = feed("bars", [[("a", day, 1.0, dt.datetime(2024, 1, 1))], [("a", day, 1.0, dt.datetime(2024, 1, 1)), ("b", day, 2.0, dt.datetime(2024, 1, 2))]], schema)
    flows.stream_bars(bars, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert sinks.current(spark, str(tmp_path / "out")).count() == 2
    seen = []
    snaps = feed("snap", [[("s", 1, "x")], [("s", 1, "y")], [("s", 1, "y")]], "sheet string, row_no int, row_hash string")
    flows.stream_changes(snaps, str(tmp_path / "state"), lambda c: seen.append(c.count()), str(tmp_path / "c2")).awaitTermination(90)
    assert sum(seen) >= 1 and sinks.current(spark, str(tmp_path / "state")).count() == 1
    items = feed("items", [[("t", 1.0, dt.datetime(2024, 1, 1, 5)), ("t", 0.0, dt.datetime(2024, 1, 1, 6))]], "ticker string, value double, ts timestamp")
    q = flows.daily_counts(items).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination(60)
    assert spark.table("daily").first()["n"] == 2


def test_late_rows_are_dropped(spark, tmp_path):
    at, seen = lambda d: dt.datetime(2024, 1, d, 5), []
    for k, rows in enumerate([[("t", 1.0, at(20))], [("t", 1.0, at(21))], [("t", 1.0, at(5)), ("t", 1.0, at(15))]]):
        spark.createDataFrame(rows, "ticker string, value double, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    feed = spark.readStream.schema("ticker string, value double, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    each = lambda df, _: seen.extend(str(r["day"]["start"].date()) for r in df.collect())
    flows.daily_counts(feed).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(seen) == ["2024-01-15", "2024-01-20", "2024-01-21"]


def test_exact_ranks_and_medians(spark):
    import random

    from quantloom.functions.tables import median, ranked

    rng = random.Random(1)
    rows = [(k % 3, rng.randrange(40), k) for k in range(500)]
    out = ranked(spark.createDataFrame(rows, "g int, v int, k int"), ["g"], ["v", "k"]).collect()
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        assert {r["k"]: (r["rank"], r["total"]) for r in out if r["g"] == g} == {r[2]: (i, len(own)) for i, r in enumerate(own)}
    for values in ([3.0] * 90 + [1.0] * 5 + [9.0], [1.0, 2.0, 4.0, None, 8.0], [5.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert median(df, "v").first()[0] == pd.Series(values).median()
    assert median(df.limit(0), "v").first()[0] is None


def test_export_blank_rows_and_nested_financials(spark):
    from quantloom.operators import fundamentals

    rows = spark.sql("select * from values ('a', 1, 0, cast(null as double), 1.23456789D, 9.0D), ('a', 2, 1, 5.0D, 2.0D, 9.0D) as t(symbol, row_no, predicted, forecast, x, y_logret_h1)")
    pred = spark.sql("select * from values ('a', 1, 7.0D) as t(symbol, row_no, forecast)")
    out = {r["row_no"]: r.asDict() for r in changes.engineered_with_predictions(rows, pred).collect()}
    assert out[1] == {"symbol": "a", "row_no": 1, "predicted": 1, "forecast": 7.0, "x": 1.234568} and out[2]["forecast"] == 5.0
    assert clean.drop_blank_rows(spark.sql("select * from values ('', ' '), (null, 'x') as t(a, b)"), ["a", "b"]).count() == 1
    df = spark.sql("select 1 as id, 2.5D as debt, cast(null as double) as equity")
    back = fundamentals.decode_financials(fundamentals.encode_financials(df, ["debt", "equity"]).unionByName(spark.sql("select 2 as id, 'bad' as financials")), ["debt", "equity"])
    assert sorted(((r["id"], r["debt"], r["equity"]) for r in back.collect()), key=str) == [(1, 2.5, None), (2, None, None)]


def test_rows_that_lack_a_key_are_kept(spark, tmp_path):
    make = lambda rows, schema="ticker string, hash int": spark.createDataFrame(rows, schema)
    root = str(tmp_path / "m")
    sinks.merge_stage(make([("x", 1), ("x", 2), ("y", 3)]), root, ["ticker", "hash"], [])
    assert sinks.merge_stage(make([("x",)], "ticker string"), root, ["ticker", "hash"], []) == 4
    assert sinks.merge_stage(make([("x", 2, 5)], "ticker string, hash int, more int"), root, ["ticker", "hash"], []) == 4
    assert sorted(map(str, sinks.current(spark, root).collect())) == sorted(map(str, make([("x", 1, None), ("x", 2, 5), ("y", 3, None), ("x", None, None)], "ticker string, hash int, more int").collect()))
    bare = str(tmp_path / "b")
    assert sinks.merge_stage(make([("x", 1), ("x", 1)]), bare, ["absent"], []) == 2 and sinks.merge_stage(make([("x", 1)]), bare, ["absent"], []) == 3
    inbox = str(tmp_path / "i")
    for rows in ([("x", 1), ("x", 2)], [("y", 1)]):
        sinks.stage(make(rows), inbox, replace=False)
    assert sinks.pending(spark, inbox, ["absent"]).count() == 3 and sinks.pending(spark, inbox, ["ticker", "absent"]).count() == 2
    got = []
    assert sinks.drain(spark, inbox, lambda df: got.extend(df.collect()) or len(got), ["absent"]) == 3 and len(got) == 3
    with pytest.raises(ValueError):
        scalars.last_by(make([("x", 1)]), [], ["hash"])


@pytest.mark.parametrize("at", range(5))
def test_a_delivery_counts_once_wherever_a_run_dies(spark, tmp_path, monkeypatch, at):
    """The at-th note or table of the first drain isn't written; the next run delivers what is missing, and nothing twice."""
    inbox, out = str(tmp_path / "i"), sinks.Once(str(tmp_path / "o"))
    make = lambda *rows: spark.createDataFrame(rows, "key string, v int")
    assert sinks.stage(make(("a", 1), ("b", 1)), inbox, replace=False, name="one") and not sinks.stage(make(("a", 9)), inbox, replace=False, name="one")
    steps, append = [], sinks._append

    def fails(*args):
        steps.append(args[1])
        if len(steps) == at + 1:
            raise OSError("lost")
        return append(*args)

    monkeypatch.setattr(sinks, "_append", fails)
    died = False
    try:
        sinks.drain(spark, inbox, out, ["key"], ["v"])
    except OSError:
        died = True
    monkeypatch.setattr(sinks, "_append", append)
    assert died == (at < 4) and len(steps) == min(at + 1, 4)
    assert not sinks.stage(make(("a", 9)), inbox, replace=False, name="one")
    sinks.stage(make(("b", 2), ("c", 2)), inbox, replace=False, name="two")
    sinks.drain(spark, inbox, out, ["key"], ["v"])
    # Where the first run noted nothing, the batches go together and the last row of a key counts.
    assert sorted(map(tuple, out.rows(spark).collect())) == ([("a", 1), ("b", 2), ("c", 2)] if at == 0 else [("a", 1), ("b", 1), ("b", 2), ("c", 2)])
    assert sinks.drain(spark, inbox, out, ["key"], ["v"]) is None and sinks.pending(spark, inbox) is None and sinks._attempt(spark, inbox) is None


def test_watermark_state_goes_on_after_a_restart(spark, tmp_path):
    day, kind = lambda d: dt.date(2024, 1, d), "symbol string, date date, more int"
    feed, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))

    def run(k, rows):
        spark.createDataFrame([(*r, 1) for r in rows], kind).repartition(2).write.parquet(f"{feed}/{k}")
        sdf = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(feed)
        flows.stream_watermarks(sdf, target, checkpoint).awaitTermination(120)
        return sorted((r["symbol"], r["last_date"].day) for r in flows.watermarks(spark, target).collect())

    assert flows.watermarks(spark, target) is None
    assert run(0, [("a", day(5)), ("a", day(3)), ("b", day(2)), (None, day(9)), ("n", None)]) == [("a", 5), ("b", 2)]
    # A new query from the checkpoint: a late row moves nothing back, and only what moves is written.
    assert run(1, [("a", day(4)), ("b", day(7)), ("c", day(1))]) == [("a", 5), ("b", 7), ("c", 1)]
    assert sorted((r["symbol"], r["last_date"].day) for r in sinks.Once(target).rows(spark).collect()) == [("a", 5), ("b", 2), ("b", 7), ("c", 1)]
    assert run(2, [("b", day(7)), ("c", day(1))]) == [("a", 5), ("b", 7), ("c", 1)]
    assert sinks.Once(target).rows(spark).count() == 4


def test_only_rows_under_unequal_hashes_are_joined(spark):
    kind = "sheet string, row_no int, row_hash string"
    old = [("same", k, f"h{k}") for k in range(40)] + [("edit", k, f"h{k}") for k in range(40)] + [("gone", 1, "x"), ("less", 0, "a"), ("less", 9, "b"), (None, 1, "n"), ("nulls", None, "p"), ("nulls", 2, None)]
    new = [("same", k, f"h{k}") for k in range(40)] + [("edit", k, "new" if k == 13 else f"h{k}") for k in range(41)] + [("new", 5, "x"), ("less", 0, "a"), (None, 1, "m"), ("nulls", None, "p"), ("nulls", 2, "q")]
    prev, cur = (spark.createDataFrame(rows, kind) for rows in (old, new))
    blocks = changes.unequal_blocks(changes.hash_tree(prev, 8), changes.hash_tree(cur, 8), 8)
    assert {(r["sheet"], r["block"]) for r in blocks.collect()} == {("edit", 1), ("edit", 5), ("gone", 0), ("less", 1), ("new", 0), (None, 0), ("nulls", 0)}
    reach = changes.rows_in(prev, blocks, 8).collect()
    assert not any(r["sheet"] == "same" for r in reach) and sorted(r["row_no"] for r in reach if r["sheet"] == "edit") == list(range(8, 16))
    out = {r["sheet"]: (r["change"], r["added_rows"], r["modified_rows"], r["removed_rows"]) for r in changes.diff_snapshots(prev, cur, changes.hash_tree(prev, 8), fan=8).collect()}
    assert out == {"edit": ("updated", 1, 1, 0), "gone": ("sheet_removed", 0, 0, 1), "new": ("sheet_added", 1, 0, 0), "nulls": ("updated", 0, 1, 0)} | ({None: out[None]} if None in out else {})
    assert changes.diff_snapshots(prev, cur).where("sheet <> 'nulls'").count() == len(set(out) - {None, "nulls"})
    assert changes.diff_snapshots(prev, prev, changes.hash_tree(prev, 8), fan=8).count() == 0 and changes.diff_snapshots(prev.limit(0), prev.limit(0)).count() == 0
    assert changes.diff_snapshots(prev, cur, changes.hash_tree(prev, 8), changes.hash_tree(cur, 8), 8).count() == len(out)


def test_headers_are_distinct_in_any_case(spark):
    assert schemas.clean_headers(["Close", "close"]) == ["Close", "close_2"] and schemas.clean_headers(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert schemas.clean_headers(["a", "A", "a", "A_2", "", "column_5"]) == ["a", "A_3", "a_4", "A_2", "Column_5", "column_5_2"]
    names = schemas.clean_headers(["x", "X", "x_2", "X_2", "", "Column_5", " x "])
    assert len({n.lower() for n in names}) == len(names) and spark.createDataFrame([tuple(range(len(names)))], names).select(*names).count() == 1


def test_missing_symbols_in_any_case(spark):
    have = spark.createDataFrame([("INFY",), (" tcs ",), (None,)], "symbol string")
    want = spark.createDataFrame([("infy", 1), (" Tcs", 2), ("none", 3), (None, 4)], "symbol string, k int")
    assert sorted(r["k"] for r in clean.missing_symbols(have, want).collect()) == [3, 4]


@pytest.mark.parametrize("shuffled", [False, True])
def test_tags_by_rarest_tokens(spark, monkeypatch, shuffled):
    from quantloom.functions import tables

    if shuffled:
        monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    posts = [(1, "The Bank of X rose; the bank fell"), (2, "the river bank"), (3, None), (4, "AT&T and at t"), (5, "the the the"), (6, "bank of xy"), (7, "at&tx")] + [(k, "the common text") for k in range(10, 60)]
    terms = [("BX", "the bank of x"), ("RIV", "river"), ("RIV", "the river"), ("ATT", "AT&T"), ("EMPTY", "!!"), ("NULL", None), ("GONE", "the zebra")]
    df = spark.createDataFrame(posts, "id int, body string").repartition(3)
    out = text.tag_entities(df, spark.createDataFrame(terms, "ticker string, term string"), "id", "body")
    assert sorted((r["id"], r["ticker"]) for r in out.where("ticker <> 'GENERAL'").collect()) == [(1, "BX"), (2, "RIV"), (4, "ATT")]
    assert out.count() == len(posts) and set(out.columns) == {"id", "body", "ticker"}
    inner = text.tag_entities(df, spark.createDataFrame(terms, "ticker string, term string"), "id", "body", None)
    assert sorted(r["id"] for r in inner.collect()) == [1, 2, 4]
    assert text.tag_entities(df, spark.createDataFrame([], "ticker string, term string"), "id", "body").where("ticker = 'GENERAL'").count() == len(posts)


def test_sentiment_reads_posts_once_more_and_shuffles_eight_times(spark, tmp_path):
    """With the tokens written, the plan has one scan of the posts and at most eight exchanges."""
    from quantloom.plans import registry

    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a thing of attion").alias("text"), F.lit("src0").alias("source"), F.lit(9).cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = text.aggregate_sentiment(registry.texts.weighted(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("text:string") == 1 and plan.count("Exchange hashpartitioning") <= 8, plan


def test_open_lots_are_kept_between_batches(spark, tmp_path):
    """Trades cut into batches anywhere, some runs from the checkpoint, give the profit of the whole table."""
    import random

    from quantloom.operators import metrics

    rng, kind = random.Random(4), "symbol string, side string, qty double, price double, seq int"
    rows = [(rng.choice("ab"), rng.choice(["buy", "sell"]), float(rng.randint(1, 9)), float(rng.randint(50, 90)), k) for k in range(120)] + [("only", "buy", 5.0, 1.0, 500)]
    want = sorted((r["symbol"], r["qty"], round(r["pnl"], 6)) for r in metrics.fifo_pnl(spark.createDataFrame(rows, kind)).collect())
    cuts = sorted(rng.sample(range(1, 120), 3))
    feed, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, None])):
        spark.createDataFrame([*rows[a:b], (None, "buy", 1.0, 1.0, 0)], kind).repartition(2).write.parquet(f"{feed}/{k}")
        if k != 1:  # the second run has two batches' files at once
            flows.stream_lots(spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(feed), target, checkpoint).awaitTermination(120)
    assert sorted((r["symbol"], r["qty"], round(r["pnl"], 6)) for r in flows.profits(spark, target).collect()) == want
    example = spark.createDataFrame([("a", "buy", 10.0, 1000.0, 1), ("a", "buy", 10.0, 1200.0, 2), ("a", "sell", 15.0, 1500.0, 3)], kind)
    example.write.parquet(str(tmp_path / "e"))
    flows.stream_lots(spark.readStream.schema(kind).parquet(str(tmp_path / "e")), str(tmp_path / "p"), str(tmp_path / "d")).awaitTermination(120)
    assert flows.profits(spark, str(tmp_path / "p")).first()["pnl"] == 6500


def test_repair_totals_are_observed(spark, tmp_path):
    raw = spark.createDataFrame([("a", 1, "2024-01-02", 1.0, 2.0, 0.5, 1.5), ("a", 2, "2024-01-01", 1.0, 2.0, 0.5, 1.5), ("a", 3, "2024-01-02", 1.0, 2.0, 0.5, 1.6), ("b", 1, None, 1.0, 2.0, 0.5, 1.5), ("b", 2, "2024-01-01", 1.0, 0.1, 0.5, 1.5), ("b", 3, "2024-01-03", None, 2.0, 0.5, 1.0)], "symbol string, seq int, date string, open double, high double, low double, close double")
    bars = raw.withColumn("date", F.col("date").cast("date"))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed"))
    spark.sparkContext.setJobGroup("observed", "one pass")
    try:
        totals = clean.repair_into(bars, str(tmp_path / "good"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows, report = clean.repair(bars)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "good")).collect())) == sorted(map(tuple, rows.collect()))
    sums = report.agg(*[F.sum(c).alias(c) for c in ("before", "after", "malformed", "duplicates", "repaired_cells")]).first().asDict()
    assert {c: totals[c] for c in sums} == sums and (totals["malformed_date"], totals["malformed_range"], totals["malformed_price"], totals["malformed_close"]) == (1, 1, 1, 0)
    assert jobs() <= 2  # with adaptive execution a shuffle's stages are a job of their own


def test_a_rolling_split_is_one_pass(spark):
    from quantloom.operators import clean

    rows = [(1, k, None if k % 7 == 0 else dt.date(2020, 1, 1) + dt.timedelta(k // 3)) for k in range(40)]
    df = spark.createDataFrame(rows, "symbol int, seq int, date date")
    dated = sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[1]), reverse=True)
    old = {}
    for r in dated[5:]:
        old.setdefault(r[2], r[1])
    keep, archive = clean.split_rolling(df, 5)
    assert {r["seq"] for r in keep.collect()} == {r[1] for r in rows if not r[2]} | {r[1] for r in dated[:5]} and sorted(r["seq"] for r in archive.collect()) == sorted(old.values())
    plan = clean.rolling_parts(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Sort [") == 1


def test_dates_are_tried_by_shape_with_the_same_days(spark):
    from quantloom.functions import scalars

    texts = ["2020-01-02", "2020-1-2", " 2020-01-02 ", "2020-01-02 03:04:05", "02-01-2020", "02/01/2020", "13/12/2020", "12/13/2020", "2020/01/02", "02-Jan-2020", "20200102", "2020-01-02T03:04:05", "", "x", "/", "31/02/2020", "+12020-01-02", "02-JAN-2020", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.to_date(F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in scalars.FORMATS]))
    assert all(r[0] == r[1] for r in df.select(plain.cast("string"), scalars.parse_date(F.col("t")).cast("string")).collect())
    assert set(scalars.SHAPES) == set(scalars.FORMATS)


def test_open_lots_of_a_bucket_are_read_and_written_once_a_symbol():
    """A bucket's symbols come out as one frame, and each is one read and one write of the state, however many lots it has open."""
    import pandas as pd

    calls, held = [], {}

    class State:
        def getValue(self, key):
            calls.append("get")
            return held.get(key)

        def updateValue(self, key, value):
            calls.append("put")
            held[key] = value

        def removeKey(self, key):
            calls.append("remove")
            del held[key]

    lots = flows._Lots("string")
    lots.init(type("Handle", (), {"getMapState": lambda *_: State()})())
    frame = lambda rows: pd.DataFrame(rows, columns=["symbol", "seq", "side", "qty", "price"])
    assert list(lots.handleInputRows((0,), iter([frame([(s, k, "buy", 1.0, float(k)) for k in range(200) for s in "ab"])]), None)) == []
    out = list(lots.handleInputRows((0,), iter([frame([("b", 301, "sell", 150.5, 500.0)]), frame([("a", 300, "sell", 200.0, 10.0), ("a", 302, "sell", 2.0, 10.0)])]), None))
    assert len(out) == 1 and sorted(out[0].itertuples(index=False, name=None)) == [("a", 200.0, 2000.0 - sum(range(200))), ("b", 150.5, 150.5 * 500 - sum(range(150)) - 75.0)]
    assert calls == ["get", "put"] * 4 and held[("a",)][0] == "sell"
    assert [t for pdf in lots.handleInputRows((0,), iter([frame([("a", 400, "buy", 2.0, 4.0)])]), None) for t in pdf.itertuples(index=False, name=None)] == [("a", 2.0, 12.0)] and ("a",) not in held


def test_a_batch_of_bars_goes_through_its_state_once_and_its_parts_are_few_files(spark, tmp_path, monkeypatch):
    import json

    from quantloom.plans import fixtures

    monkeypatch.setattr(sinks, "SLICE_ROWS", 50, raising=False)
    rows = spark.range(400).select((F.col("id") % 40).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 40).cast("int") * 6).alias("date"), F.col("id").cast("double").alias("close"))
    rows = rows.withColumn("ts", F.col("date").cast("timestamp"))
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    made = rows.mapInArrow(counted, rows.schema)
    feed = fixtures.feed(spark, [made.where("date < '2024-02-10'"), rows.where("date >= '2024-02-10'").unionByName(rows.where("date > '2024-02-03' and date < '2024-02-10'"))], "bars")
    assert runs.value == 400
    out = str(tmp_path / "out")
    q = flows.stream_bars(feed, out, str(tmp_path / "ck"))
    q.awaitTermination()
    passed = [json.loads(p.json) for p in q.recentProgress]
    assert [p["numInputRows"] for p in passed if p["numInputRows"]] == [280, 160]
    table = sinks.current(spark, out)
    assert sorted(map(tuple, table.select("symbol", "date", "close").collect())) == sorted(map(tuple, rows.select("symbol", "date", "close").collect()))
    # A part has a file a slice of its keys at most, whatever the number of tasks; none is a task's whole.
    files = [f.split("_part=")[1].split("/")[0] for f in table.inputFiles()]
    assert 2 <= files.count("2024-01") <= 5 and 2 <= files.count("2024-02") <= 5


def test_parts_of_a_feed_have_equal_numbers_of_files(spark):
    from quantloom.plans import fixtures

    feed = fixtures.feed(spark, [spark.range(1000), spark.range(2), spark.range(500)], "uneven")
    seen = []
    feed.writeStream.foreachBatch(lambda df, _: seen.append(df.count())).trigger(availableNow=True).option("checkpointLocation", fixtures.new_path(spark, "ck")).start().awaitTermination()
    assert seen == [1000, 2, 500]


def test_an_archive_report_sorts_once_and_joins_nothing(spark):
    day = lambda d: d and dt.date(2024, 1, d)
    make = lambda rows: spark.createDataFrame([(s, day(d), q) for s, d, q in rows], "symbol string, date date, seq int")
    df = make([("a", 9, 1), ("a", 8, 2), ("a", 8, 3), ("a", 8, 4), ("a", 7, 5), ("a", 6, 6), ("a", 6, 7), ("a", None, 8), ("b", 9, 1), ("c", 5, 1), ("c", 4, 2), ("c", 3, 3)])
    # An archive that has a day twice, days of its own, a row without day and a symbol of its own.
    archive = make([("a", 7, 0), ("a", 7, 0), ("a", 2, 0), ("a", None, 0), ("c", 3, 0), ("z", 1, 0)])
    out = clean.archive_report(df.repartition(3, "symbol"), archive.repartition(3, "symbol"), keep=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count(" Sort [") == 1
    got = {r["symbol"]: (r["rows_seen"], r["undated"], r["candidates"], r["appended"], r["duplicates"], r["oldest"], r["newest"], r["status"]) for r in out.collect()}
    assert got == {"a": (8, 1, 5, 2, 3, day(6), day(8), "ok"), "b": (1, 0, 0, 0, 0, None, None, "skipped"), "c": (3, 0, 1, 0, 1, day(3), day(3), "ok")}


def test_symbol_folders_are_listed_by_few_tasks(spark, tmp_path):
    sinks.write_features(spark.range(90).select(F.col("id").alias("symbol"), (F.col("id") * 2).alias("v")), str(tmp_path / "f"))
    limit, sc = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(limit)
    sc.setJobGroup("list-folders", "")
    try:
        rows = readers.read_symbol_dirs(spark, str(tmp_path / "f"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [x for j in sc.statusTracker().getJobIdsForGroup("list-folders") for x in sc.statusTracker().getJobInfo(j).stageIds]
    tasks = [sc.statusTracker().getStageInfo(x).numTasks for x in stages]
    assert tasks and max(tasks) <= 4 * sc.defaultParallelism and spark.conf.get(limit) == before
    assert rows.count() == 90 and rows.where("v <> symbol * 2").isEmpty()


def test_integrity_counts_duplicates_without_a_table_of_all_dates(spark):
    day = lambda k: k and dt.date(2020, 1, k)
    rows = [("a", n, day(k)) for n, k in enumerate((3, 3, None, 4, 1, None, 1, 3))] + [("b", n, day(n + 1)) for n in range(4)] + [("c", n, None) for n in range(3)] + [("d", 0, day(5)), ("d", 1, None), ("d", 2, day(4))]
    out = clean.integrity_report(spark.createDataFrame(rows, "symbol string, seq int, date date").repartition(3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = {r["symbol"]: (r["n_dates"], r["duplicate_dates"], r["chronological"], r["blank_dates"], r["problems"], r["ok"]) for r in out.collect()}
    assert got == {"a": (6, 3, False, 2, "duplicates,order,blanks", False), "b": (4, 0, True, 0, "", True), "c": (0, 0, True, 3, "blanks", False), "d": (2, 0, True, 1, "blanks", False)}
    assert plan.count("HashAggregate(") == 2 and "distinct" not in plan and plan.count("Exchange hashpartitioning") == 1
