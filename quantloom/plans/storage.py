"""Queries that go through sources, sinks and streams: tables are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.tables import new_path
from quantloom.operators import clean, text
from quantloom.plans.fixtures import BARS, bars, feed, table
from quantloom.plans.registry import query
from quantloom.plans.rounding import rounded
from quantloom.plans.rounding import sql_round as _r
from quantloom.plans.tables import SNAPSHOTS, snapshots
from quantloom.plans.texts import POSTS, aliases, posts, tagged
from quantloom.sources import feeds, readers, sinks
from quantloom.streaming import flows

_OHLCV = ("open", "high", "low", "close", "volume")


@query("s1_staged_parquet", f"WITH {BARS} SELECT symbol, date, {_r('close', 'close')} FROM bars")
def s1_staged(spark, sf_dir):
    """A staged table, and one that isn't there, which gives no rows."""
    path, schema = new_path(spark, "staged"), "symbol long, date date, close double"
    bars(spark, sf_dir).select(F.col("symbol").cast("long").alias("symbol"), "date", "close").write.parquet(path)
    return rounded(readers.read_staged(spark, path, schema).unionByName(readers.read_staged(spark, path + "-none", schema)), "close")


@query("s2_csv_bars", f"WITH {BARS} SELECT symbol::VARCHAR AS symbol, date, {', '.join(_r(f'CASE WHEN day(date) % 6 <> 0 THEN {c} END' if c == 'high' else c, c) for c in _OHLCV)} FROM bars")
def s2_csv(spark, sf_dir):
    path, b = new_path(spark, "csv"), bars(spark, sf_dir)
    b.select("symbol", "date", *[(F.when(F.dayofmonth("date") % 6 == 0, "n/a").otherwise(F.col(c).cast("string")) if c == "high" else F.col(c)).alias(c) for c in _OHLCV]).write.option("header", True).csv(path)
    return rounded(readers.read_csv_bars(spark, path), *_OHLCV)


@query("s3_s13_symbol_folders", f"WITH {BARS} SELECT symbol, date, {_r('close', 'close')}, {_r('volume', 'volume')} FROM bars")
def s3_folders(spark, sf_dir):
    path = new_path(spark, "features")
    sinks.write_features(bars(spark, sf_dir).select("symbol", "date", "close", "volume"), path)
    return rounded(readers.read_symbol_dirs(spark, path).withColumn("symbol", F.col("symbol").cast("long")), "close", "volume")


@query("s4_posts_listing", f"WITH {POSTS} SELECT 't' || doc_id AS title, score, CAST(date AS VARCHAR) AS day, 'https://www.reddit.com/r/' || doc_id AS url FROM posts WHERE date >= DATE '2024-02-01'", dated=False)
def s4_listing(spark, sf_dir):
    """Posts as pages of a nested listing, fifty each, read and cut at a day."""
    path, d = new_path(spark, "listing"), F.col("doc_id")
    post = F.struct(F.concat(F.lit("t"), d).alias("title"), F.col("body").alias("selftext"), "score", F.unix_timestamp(F.col("date").cast("timestamp")).cast("double").alias("created_utc"), F.concat(F.lit("/r/"), d).alias("permalink"))
    pages = posts(spark, sf_dir).groupBy(F.floor(d / 50).alias("page")).agg(F.collect_list(F.struct(post.alias("data"))).alias("children"))
    pages.select(F.to_json(F.struct(F.struct("children").alias("data"))).alias("value")).write.text(path)
    out = readers.posts_from_listing(spark, path, F.lit("2024-02-01").cast("timestamp"), multi_line=False)
    return out.select("title", "score", F.to_date("ts").cast("string").alias("day"), "url")


def _pages(spark, sf_dir, where: str, root: str) -> None:
    """Posts of a channel and day as a page, the day its number."""
    d, day = F.col("doc_id"), F.unix_timestamp(F.col("date").cast("timestamp"))
    post = F.struct(F.concat(F.lit("t"), d).alias("title"), F.col("body").alias("selftext"), "score", day.cast("double").alias("created_utc"), F.concat(F.lit("/r/"), d).alias("permalink"))
    rows = posts(spark, sf_dir).where(where).select(F.col("channel").alias("feed"), F.floor(day / 86_400).alias("page"), F.col("doc_id").alias("seq"), post.alias("post"))
    feeds.write_pages(rows, root)


_PAGED = "SELECT 't' || doc_id AS title, channel AS feed, score, length(body) AS size, CAST(date AS VARCHAR) AS day, 'https://www.reddit.com/r/' || doc_id AS url"


@query("s4_l4_u4_feed_pages", f"WITH {POSTS} {_PAGED} FROM posts WHERE date >= DATE '2024-02-01' AND channel IN ('news', 'reddit')", dated=False)
def s4_pages(spark, sf_dir):
    """Two feeds of three, read page by page from the newest to the first that is older than a day."""
    path = new_path(spark, "feeds")
    _pages(spark, sf_dir, "true", path)
    out = feeds.read_feed(spark, path).where((F.col("ts") >= F.lit("2024-02-01").cast("timestamp")) & F.col("feed").isin("news", "reddit"))
    return out.select("title", "feed", "score", F.length("body").cast("long").alias("size"), F.to_date("ts").cast("string").alias("day"), "url")


@query("s4_l4_feed_stream", f"WITH {POSTS} {_PAGED} FROM posts WHERE date >= DATE '2024-02-01'", dated=False)
def s4_stream(spark, sf_dir):
    """The feeds as a stream that is started twice: the first run goes back to its first old page, the second has the pages that came since."""
    path, out, checkpoint = new_path(spark, "feeds"), new_path(spark, "posts"), new_path(spark, "ck")
    for days in ("date < '2024-03-01'", "date >= '2024-03-01'"):
        _pages(spark, sf_dir, days, path)
        sdf = feeds.stream_feed(spark, path, cutoff="2024-02-01")
        sdf.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.select("title", "feed", "score", F.length("body").cast("long").alias("size"), F.to_date("ts").cast("string").alias("day"), "url")


@query("s5_news_items", "SELECT 'n' || doc_id AS title, 'http://n/' || doc_id AS url, source FROM documents WHERE doc_id % 5 <> 0", dated=False)
def s5_news(spark, sf_dir):
    """Items in the nested and the flat shape; every fifth lacks its link or its time."""
    d, t = F.col("doc_id"), F.concat(F.lit("n"), F.col("doc_id"))
    link = F.when(d % 10 != 0, F.concat(F.lit("http://n/"), d))
    nested = F.to_json(F.struct(F.struct(t.alias("title"), F.struct(link.alias("url")).alias("canonicalUrl"), F.struct(F.col("source").alias("displayName")).alias("provider"), F.when(d % 5 != 0, "2024-01-02T03:04:05Z").alias("pubDate")).alias("content")))
    flat = F.to_json(F.struct(t.alias("title"), link.alias("link"), F.col("source").alias("publisher"), F.when(d % 5 != 0, d + 1700000000).alias("providerPublishTime")))
    raw = table(spark, sf_dir, "documents").select(F.when(d % 2 == 0, nested).otherwise(flat).alias("raw"))
    return readers.news_from_items(raw).select("title", "url", "source")


@query("s6_alias_terms", """SELECT DISTINCT p_partkey::VARCHAR AS ticker, p_name AS name, p_brand AS sector, term FROM (SELECT *, unnest([p_name, p_type, p_name]) AS term FROM part) WHERE trim(term) <> ''""", dated=False)
def s6_aliases(spark, sf_dir):
    path, p = new_path(spark, "aliases"), table(spark, sf_dir, "part")
    one = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("sector"), F.array("p_name", "p_type", "p_name").alias("aliases"))
    p.groupBy(F.floor(F.col("p_partkey") / 200)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), one))).alias("m")).select(F.to_json("m").alias("value")).repartition(8).write.text(path)
    return readers.alias_dim(spark, path, whole_file=False)


@query("p23_company_names", f"""WITH {POSTS}, al AS (SELECT unnest(['thing', 'attion', 'thatin', 'ononst', 'inoran', 'hehely', 'orantion']) AS term),
tags AS (SELECT DISTINCT doc_id, upper(term) AS ticker FROM posts JOIN al ON regexp_matches(lower(body), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])'))
SELECT doc_id, coalesce(ticker, 'GENERAL') AS ticker, CASE WHEN ticker IS NULL THEN 'General' WHEN ticker IN ('THING', 'ATTION') THEN lower(ticker) || ' ltd' ELSE ticker END AS company_name FROM posts LEFT JOIN tags USING (doc_id)""", dated=False)
def p23_names(spark, sf_dir):
    names = aliases(spark).where("ticker in ('THING', 'ATTION')").select("ticker", F.concat("term", F.lit(" ltd")).alias("name"))
    return readers.company_names(tagged(spark, sf_dir), names).select("doc_id", "ticker", "company_name")


_TWO = f"""{BARS}, a AS (SELECT symbol, date, close, 0 AS batch FROM bars WHERE day(date) % 3 <> 0), b AS (SELECT symbol, date, close + 1 AS close, 1 AS batch FROM bars WHERE day(date) % 2 = 0),
u AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY batch DESC) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b))"""


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b = bars(spark, sf_dir).select("symbol", "date", "close")
    return b.where(F.dayofmonth("date") % 3 != 0), b.where(F.dayofmonth("date") % 2 == 0).withColumn("close", F.col("close") + 1)


@query("s7_s14_s15_u4_inbox", f"WITH {_TWO} SELECT symbol, date, {_r('close', 'close')}, (SELECT count(*) FROM u WHERE k = 1) AS delivered FROM u WHERE k = 1")
def s7_inbox(spark, sf_dir):
    """A sink that fails once: what it was handed waits, joins the next batch of the feed reader, and all is delivered once."""
    root, out = new_path(spark, "inbox"), new_path(spark, "delivered")
    first, second = _two(spark, sf_dir)
    sinks.stage(first, root)
    keys = {"keys": ["symbol", "date"], "order": ["close"]}
    sinks.collect(spark, root, lambda: second, lambda df: 0, **keys)

    def deliver(df: DataFrame) -> int:
        df.write.mode("append").parquet(out)
        return spark.read.parquet(out).count()

    sinks.collect(spark, root, lambda: second, deliver, enabled=False, **keys)
    n = sinks.drain(spark, root, deliver)  # nothing waits any more
    rows = spark.read.parquet(out)
    return rounded(rows.withColumn("delivered", F.lit(rows.count() if n is None else -1).cast("long")), "close", "delivered")


@query("s8_merge_by_month", f"WITH {_TWO} SELECT symbol, date, {_r('close', 'close')} FROM u WHERE k = 1")
def s8_merge(spark, sf_dir):
    root = new_path(spark, "merged")
    for rows in _two(spark, sf_dir):
        sinks.merge_stage(rows, root, ["symbol", "date", "absent"], ["close"], F.date_format("date", "yyyy-MM"))
    sinks.vacuum(spark, root)
    return rounded(sinks.current(spark, root), "close")


@query("s8_s14_missing_keys", f"""WITH {_TWO}, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY close DESC) AS k FROM b)
SELECT 'merged' AS side, symbol, date, {_r('close', 'close')} FROM a UNION ALL SELECT 'merged', symbol, NULL, {_r('close', 'close')} FROM n WHERE k = 1
UNION ALL SELECT 'drained', symbol, date, {_r('close', 'close')} FROM a UNION ALL SELECT 'drained', symbol, NULL, {_r('close', 'close')} FROM b""")
def s8_missing(spark, sf_dir):
    """A batch that lacks a key replaces only rows that lack it too; without any key, no row replaces another."""
    first, second = _two(spark, sf_dir)
    second = second.drop("date")
    root, inbox, out = (new_path(spark, x) for x in ("merged", "inbox", "delivered"))
    for rows in (first, second):
        sinks.merge_stage(rows, root, ["symbol", "date"], ["close"])
        sinks.stage(rows, inbox, replace=False)
    sinks.drain(spark, inbox, sinks.Once(out), ["absent"], ["close"])
    both = sinks.current(spark, root).withColumn("side", F.lit("merged")).unionByName(sinks.Once(out).rows(spark).withColumn("side", F.lit("drained")))
    return rounded(both, "close", keys=("side", "symbol", "date"))


@query("s10_p12_aligned_append", f"""WITH {BARS} SELECT symbol, date, {_r('close', 'close')}, CASE WHEN day(date) % 3 <> 0 THEN 1 ELSE 0 END AS predicted, '' AS forecast FROM bars WHERE day(date) % 3 <> 0
UNION ALL SELECT symbol, date, {_r('close', 'close')}, 0, '' FROM bars WHERE day(date) % 2 = 0""")
def s10_append(spark, sf_dir):
    from quantloom.functions.schemas import ensure_columns

    path, cols = new_path(spark, "appended"), ["symbol", "date", "close", "predicted", "forecast"]
    b = bars(spark, sf_dir).select("symbol", "date", "close")
    old = b.where(F.dayofmonth("date") % 3 != 0).withColumn("predicted", F.lit(1))
    ensure_columns(old, ["SYMBOL", "forecast"]).na.fill("").write.parquet(path)
    sinks.append_aligned(b.where(F.dayofmonth("date") % 2 == 0).withColumnRenamed("close", "CLOSE"), path, cols, {"predicted": 0, "forecast": ""})
    return rounded(spark.read.schema("symbol long, date date, close double, predicted int, forecast string").parquet(path).na.fill(""), "close", "predicted", "forecast")


@query("s11_results", f"WITH {BARS}, s AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) SELECT bars.symbol::VARCHAR AS symbol, date, {_r('close', 'close')}, n FROM bars JOIN s USING (symbol)")
def s11_results(spark, sf_dir):
    path, b = new_path(spark, "results"), bars(spark, sf_dir).select("symbol", "date", "close")
    for _ in range(2):  # a second run replaces the first
        sinks.write_results(b, b.groupBy("symbol").agg(F.count("*").alias("n")), path)
    counts = spark.read.schema("symbol string, n long").json(f"{path}/metrics")
    rows = spark.read.schema("symbol string, date date, close double").option("header", True).csv(f"{path}/predictions")
    return rounded(rows.join(counts, "symbol"), "close", "n")


@query("s12_a22_document_files", f"""WITH {POSTS}, al AS (SELECT unnest(['thing', 'attion', 'thatin', 'ononst', 'inoran', 'hehely', 'orantion']) AS term),
tags AS (SELECT DISTINCT doc_id, upper(term) AS ticker FROM posts JOIN al ON regexp_matches(lower(body), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])'))
SELECT coalesce(ticker, 'GENERAL') AS ticker, left(sha256(url), 16) AS item, url, score FROM posts LEFT JOIN tags USING (doc_id) WHERE doc_id % 7 <> 0""", dated=False)
def s12_documents(spark, sf_dir):
    """Documents written as JSON and read again; posts without a key of their own are left out."""
    path = new_path(spark, "documents")
    df = tagged(spark, sf_dir).withColumn("url_hash", F.when(F.col("doc_id") % 7 != 0, text.hash_key(F.col("url"))))
    sinks.write_documents(text.documents(df, "ticker", "url_hash", ["url", "score"], "date", most=500), path, "ticker")
    read = spark.read.schema("ticker string, items map<string,struct<url:string,score:long>>").json(path)
    return read.select("ticker", F.explode("items").alias("item", "v")).select("ticker", "item", "v.url", "v.score")


@query("x1_stream_bars", f"WITH {BARS} SELECT symbol, date, {_r('close', 'close')} FROM bars")
def x1_bars(spark, sf_dir):
    """Three batches by year, the second with rows of the first again."""
    b, out = bars(spark, sf_dir).withColumn("ts", F.col("date").cast("timestamp")), new_path(spark, "stream-bars")
    y = F.year("date")
    flows.stream_bars(feed(spark, [b.where(y <= 1995), b.where((y <= 1998) & ((y > 1995) | (F.month("date") == 12))), b.where(y > 1998)], "bar-files"), out, new_path(spark, "ck")).awaitTermination()
    return rounded(sinks.current(spark, out), "close")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("ticker"), "value")


_LATE = """e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), kept AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-12' UNION ALL
  SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-12' AND {} > (SELECT max(ts) FROM e WHERE ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-20') - INTERVAL 7 DAY)"""


def _updates(spark, sf_dir, make, key: str) -> DataFrame:
    """Batches: the 12th to the 19th, the days from the 20th on, then what is older, of which most is too late for the first batch's
    watermark (one takes effect on late rows a batch after the next). The last update of each window counts."""
    e, out = _events(spark, sf_dir), new_path(spark, "updates")
    at = lambda d: F.lit(f"2024-01-{d}").cast("timestamp")
    batches = feed(spark, [e.where((F.col("ts") >= at(12)) & (F.col("ts") < at(20))), e.where(F.col("ts") >= at(20)), e.where(F.col("ts") < at(12))], "event-files")

    def each(batch: DataFrame, k: int) -> None:
        sinks.merge_stage(batch.select(F.to_date(f"{key}.start").alias("day"), *[c for c in batch.columns if c != key], F.lit(k).alias("k")), out, ["day", "ticker"], ["k"])

    make(batches).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", new_path(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    return sinks.current(spark, out)


@query("x2_x3_daily_counts", f"WITH {_LATE.format('day + INTERVAL 1 DAY')} SELECT CAST(day AS VARCHAR) AS day, event_type AS ticker, count(*) AS n, {_r('sum(value)', 'total', 2)} FROM kept GROUP BY day, event_type", dated=False)
def x2_daily(spark, sf_dir):
    out = _updates(spark, sf_dir, flows.daily_counts, "day")
    return rounded(out, "n", "total", digits=2, keys=("day", "ticker"))


@query("x3_sliding_sentiment", f"""WITH {_LATE.format('w + INTERVAL 3 DAY').replace('e AS (SELECT *, CAST(ts AS DATE) AS day FROM events)', 'e AS (SELECT *, CAST(ts AS DATE) - CAST(unnest([0, 1, 2]) AS INT) AS w FROM events)')}
SELECT CAST(w AS VARCHAR) AS day, event_type AS ticker, count(*) AS n, {_r('avg(value)', 'mean')}, {_r('avg((value > 0.1)::INT::DOUBLE)', 'pos_share')} FROM kept GROUP BY w, event_type""", dated=False)
def x3_sliding(spark, sf_dir):
    out = _updates(spark, sf_dir, lambda feed: flows.sliding_sentiment(feed, 3), "span")
    return rounded(out, "n", "mean", "pos_share", keys=("day", "ticker"))


@query("x4_stream_changes", f"""WITH {SNAPSHOTS} SELECT * FROM (SELECT sheet, count(*) FILTER (p.h IS NULL) AS added_rows, count(*) FILTER (p.h <> c.h) AS modified_rows, count(*) FILTER (c.h IS NULL) AS removed_rows,
  CASE WHEN count(p.h) = 0 THEN 'sheet_added' WHEN count(c.h) = 0 THEN 'sheet_removed' ELSE 'updated' END AS change FROM prev p FULL JOIN cur c USING (sheet, row_no) GROUP BY sheet) WHERE change <> 'sheet_removed' AND added_rows + modified_rows > 0""", dated=False)
def x4_changes(spark, sf_dir):
    """The first snapshot tells nothing, the second its changes, and the same one again nothing."""
    out, (prev, cur) = new_path(spark, "changes"), snapshots(spark, sf_dir)
    batches = feed(spark, [prev, cur, cur], "snapshot-files")
    flows.stream_changes(batches, new_path(spark, "state"), lambda df: df.write.mode("append").parquet(out), new_path(spark, "ck")).awaitTermination()
    return spark.read.parquet(out)


@query("x5_stream_watermarks", f"WITH {BARS} SELECT symbol, CAST(max(date) AS VARCHAR) AS last_date FROM bars GROUP BY symbol", dated=False)
def x5_watermarks(spark, sf_dir):
    b, state = bars(spark, sf_dir).select("symbol", "date"), new_path(spark, "watermarks")
    y = F.year("date")
    flows.stream_watermarks(feed(spark, [b.where(y > 1999), b.where(y <= 1995), b.where((y > 1995) & (y <= 1999))], "bar-files"), state, new_path(spark, "ck")).awaitTermination()
    return flows.watermarks(spark, state).select("symbol", F.col("last_date").cast("string").alias("last_date"))


@query("x6_retry_inbox", f"WITH {_TWO} SELECT symbol, date, {_r('close', 'close')} FROM u WHERE k = 1")
def x6_inbox(spark, sf_dir):
    """The sink fails on the first batch; with the second it gets both, the later row of each key."""
    out, tries = new_path(spark, "delivered"), []

    def sink(df: DataFrame) -> bool:
        tries.append(1)
        if len(tries) > 1:
            df.write.mode("append").parquet(out)
        return len(tries) > 1

    flows.stream_inbox(feed(spark, list(_two(spark, sf_dir)), "batch-files"), new_path(spark, "inbox"), ["symbol", "date"], ["close"], sink, new_path(spark, "ck")).awaitTermination()
    return rounded(spark.read.parquet(out), "close")


@query("x6_s14_delivery_ledger", f"WITH {_TWO} SELECT symbol, date, {_r('close', 'close')}, 2 AS deliveries FROM a UNION ALL SELECT symbol, date, {_r('close', 'close')}, 2 FROM b")
def x6_ledger(spark, sf_dir):
    """The stream dies after the first delivery was written and before it is noted as done; started again from its checkpoint, it delivers each row once."""

    class Dies(sinks.Once):
        def write(self, df: DataFrame, delivery: str) -> int:
            super().write(df, delivery)
            raise RuntimeError("lost after delivery")

    out, checkpoint, inbox = new_path(spark, "delivered"), new_path(spark, "ck"), new_path(spark, "inbox")
    batches = feed(spark, list(_two(spark, sf_dir)), "batch-files")
    for sink in (Dies(out), sinks.Once(out)):
        try:
            flows.stream_inbox(batches, inbox, ["symbol", "date"], ["close"], sink, checkpoint).awaitTermination()
        except StreamingQueryException:
            if not isinstance(sink, Dies):
                raise
    rows, n = sinks.Once(out).rows(spark), len(sinks.Once(out).deliveries(spark))
    return rounded(rows.withColumn("deliveries", F.lit(n).cast("long")), "close", "deliveries")


@query("l1_chronological", f"""WITH {BARS}, r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY close, date) AS seq, CASE WHEN day(date) % 9 <> 0 THEN date END AS date FROM bars)
SELECT symbol, seq, lag(seq) OVER (PARTITION BY symbol ORDER BY date NULLS FIRST, seq) AS before FROM r""", dated=False)
def l1_chronological(spark, sf_dir):
    """Each row with the one that stands before it of its symbol."""
    from pyspark.sql import Window

    rows = bars(spark, sf_dir).select("symbol", F.row_number().over(Window.partitionBy("symbol").orderBy("close", "date")).cast("long").alias("seq"), F.when(F.dayofmonth("date") % 9 != 0, F.col("date")).alias("date"))
    placed = clean.chronological(rows).withColumn("at", F.monotonically_increasing_id())
    return placed.select("symbol", "seq", F.lag("seq").over(Window.partitionBy("symbol").orderBy("at")).alias("before"))
