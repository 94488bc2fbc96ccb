"""Queries over posts and their sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.tables import cut, new_path
from quantloom.operators import text
from quantloom.plans.fixtures import table
from quantloom.plans.registry import query
from quantloom.plans.rounding import rounded
from quantloom.plans.rounding import sql_round as _r
from quantloom.sources import sinks

ALIASES = ("thing", "attion", "thatin", "ononst", "inoran", "hehely", "orantion")
POSTS = """posts AS (SELECT doc_id, ['news', 'reddit', 'x'][doc_id % 3 + 1] AS channel, TIMESTAMP '2024-01-01' + to_days((doc_id * 37 % 90)::INT) + to_hours(doc_id % 24) AS ts,
  CAST(DATE '2024-01-01' + (doc_id * 37 % 90)::INT AS DATE) AS date, text AS body, source AS source_label, 'Post ' || doc_id || ' of ' || source AS title, n_chars % 500 AS score, n_chars % 1000 AS followers,
  CASE WHEN doc_id % 17 <> 0 THEN 'user' END AS display_name, 'http://e/' || doc_id AS url, (doc_id * 7 % 10) / 20.0::DOUBLE AS positive, (doc_id * 3 % 10) / 20.0::DOUBLE AS negative FROM documents)"""
TAGS = f"""al AS (SELECT unnest({list(ALIASES)}) AS term), tags AS (SELECT DISTINCT doc_id, upper(term) AS ticker FROM posts JOIN al ON regexp_matches(lower(body), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')),
tagged AS (SELECT posts.*, coalesce(ticker, 'GENERAL') AS ticker FROM posts LEFT JOIN tags USING (doc_id))"""
_IMPORTANCE = "(ln(1 + CASE channel WHEN 'news' THEN 0 ELSE greatest(score, 0) END) + 1) * CASE WHEN channel <> 'x' AND lower(source_label) = 'src0' THEN 1.0 WHEN channel <> 'x' AND lower(source_label) = 'src1' THEN 0.8 WHEN channel = 'x' THEN 1.0 ELSE 0.5 END * greatest(positive + negative, 0.1)"


def posts(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.element_at(F.array(F.lit("news"), F.lit("reddit"), F.lit("x")), (d % 3 + 1).cast("int")).alias("channel"), F.date_add(F.lit("2024-01-01").cast("date"), (d * 37 % 90).cast("int")).alias("date"),
        F.col("text").alias("body"), F.col("source").alias("source_label"), F.concat(F.lit("Post "), d, F.lit(" of "), "source").alias("title"), (F.col("n_chars") % 500).alias("score"), (F.col("n_chars") % 1000).alias("followers"), F.when(d % 17 != 0, "user").alias("display_name"),
        F.concat(F.lit("http://e/"), d).alias("url"), ((d * 7 % 10) / 20.0).alias("positive"), ((d * 3 % 10) / 20.0).alias("negative"),
    )


def aliases(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a.upper()}', '{a}')" for a in ALIASES) + " AS t(ticker, term)")


def tagged(spark, sf_dir) -> DataFrame:
    return text.tag_entities(posts(spark, sf_dir), aliases(spark), "doc_id", "body")


@query("j8_entity_tags", f"WITH {POSTS}, {TAGS} SELECT doc_id, channel, ticker FROM tagged", dated=False)
def j8_tags(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", "channel", "ticker")


@query("f3_f4_retention_spam_p20_keys", f"""WITH {POSTS} SELECT doc_id, (regexp_matches(coalesce(body, ''), '(?i)giveaway|airdrop|claim now|join my') OR coalesce(followers < 25, false) OR display_name IS NULL) AS spam,
  left(sha256(url), 16) AS url_hash FROM posts WHERE date >= DATE '2024-02-01'""", dated=False)
def f3_f4(spark, sf_dir):
    df = text.retain(posts(spark, sf_dir), "date", F.lit("2024-02-01").cast("date"))
    return df.select("doc_id", text.is_spam(F.col("body"), F.col("followers"), F.col("display_name")).alias("spam"), text.hash_key(F.col("url")).alias("url_hash"))


def weighted(spark, sf_dir) -> DataFrame:
    names = spark.sql("SELECT * FROM VALUES ('src0', 1.0D), ('SRC1', 0.8D) AS t(name, weight)")
    df = text.prepare_text(tagged(spark, sf_dir), F.col("channel")).withColumn("neutral", 1.0 - F.col("positive") - F.col("negative"))
    df = text.source_quality(df, names).withColumn("source_weight", F.when(F.col("channel") == "x", 1.0).otherwise(F.col("source_weight")))
    return text.importance(df).withColumns({"polarity": F.col("positive") - F.col("negative"), "source": F.col("channel")})


@query("c1_c4_importance_p19_text", f"""WITH {POSTS}, {TAGS} SELECT doc_id, ticker, {_r(_IMPORTANCE, 'weight')}, md5(CASE channel WHEN 'news' THEN title WHEN 'reddit' THEN trim(title || chr(10) || body, ' ' || chr(9) || chr(10) || chr(13)) ELSE body END) AS text_md5 FROM tagged""", dated=False)
def c1_c4(spark, sf_dir):
    return rounded(weighted(spark, sf_dir).withColumn("text_md5", F.md5("text")), "weight", "text_md5", keys=("doc_id", "ticker"))


SENTIMENT = f"""{POSTS}, {TAGS}, sc AS (SELECT ticker, channel AS source, date, positive - negative AS polarity, {_IMPORTANCE} AS w FROM tagged),
ext AS (SELECT ticker, source, min(date) AS lo, max(date) AS hi FROM sc GROUP BY ALL),
grid AS (SELECT ticker, source, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM ext),
cnt AS (SELECT ticker, source, date, count(*) AS c FROM sc GROUP BY ALL),
agg AS (SELECT g.ticker, g.source, g.date, count(*) AS n_7d, count(*) FILTER (s.date > g.date - 3) AS n_3d,
  sum(s.w * exp(-ln(2) * (g.date - s.date) / 3.0) * polarity) / nullif(sum(s.w * exp(-ln(2) * (g.date - s.date) / 3.0)), 0) AS m7,
  sum(s.w * exp(-ln(2) * (g.date - s.date) / 1.5) * polarity) FILTER (s.date > g.date - 3) / nullif(sum(s.w * exp(-ln(2) * (g.date - s.date) / 1.5)) FILTER (s.date > g.date - 3), 0) AS m3,
  avg((polarity > 0.1)::INT) AS pos, avg((polarity < -0.1)::INT) AS neg FROM grid g JOIN sc s ON s.ticker = g.ticker AND s.source = g.source AND s.date > g.date - 7 AND s.date <= g.date GROUP BY ALL),
base AS (SELECT g.ticker, g.source, g.date, avg(c) AS mean, stddev_pop(c) AS std, coalesce(sum(c) FILTER (cnt.date = g.date), 0) AS today FROM grid g JOIN cnt ON cnt.ticker = g.ticker AND cnt.source = g.source AND cnt.date > g.date - 90 AND cnt.date <= g.date GROUP BY ALL),
sent AS (SELECT ticker, date, source, m3 AS sent_mean_3d, m7 AS sent_mean_7d, pos AS sent_pos_share, neg AS sent_neg_share, CASE WHEN std > 1e-12 THEN (today - mean) / std ELSE 0 END AS sent_volume_z, n_3d, n_7d FROM agg JOIN base USING (ticker, source, date))"""
_SENT = ("sent_mean_3d", "sent_mean_7d", "sent_pos_share", "sent_neg_share", "sent_volume_z")


@query("a13_sentiment_a9_a12_j11", f"WITH {SENTIMENT} SELECT ticker, date, source, {', '.join(_r(c, c) for c in _SENT)}, n_3d, n_7d FROM sent")
def a13_sentiment(spark, sf_dir):
    return rounded(text.aggregate_sentiment(weighted(spark, sf_dir)), *_SENT, "n_3d", "n_7d", keys=("ticker", "date", "source"))


@query("a20_s9_latest_sentiment", f"WITH {SENTIMENT}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker, source ORDER BY date DESC) AS k FROM sent) SELECT ticker, date, source, {_r('sent_mean_7d', 'sent_mean_7d')}, n_7d FROM k WHERE k = 1")
def a20_latest(spark, sf_dir):
    """The sink keeps the last day of each (ticker, source) of an earlier, shorter table and of the whole one, which replaces it."""
    df, path = cut(text.aggregate_sentiment(weighted(spark, sf_dir)), "sentiment"), new_path(spark, "latest")
    for rows in (df.where("date < date '2024-02-01'"), df):
        sinks.replace_latest(rows, path, ["ticker", "source"], ["date"])
    last = spark.read.parquet(path).join(text.latest_sentiment(df).select("ticker", "source", "date"), ["ticker", "source", "date"])
    return rounded(last, "sent_mean_7d", "n_7d", keys=("ticker", "date", "source"))


@query("l4_early_stop", f"""WITH {POSTS}, o AS (SELECT doc_id, channel, sum((date < DATE '2024-01-03')::INT) OVER (PARTITION BY channel ORDER BY doc_id DESC) AS old FROM posts) SELECT doc_id, channel FROM o WHERE old = 0""", dated=False)
def l4_early_stop(spark, sf_dir):
    df = posts(spark, sf_dir).withColumn("seq", -F.col("doc_id"))
    return text.take_until_old(df, "channel", "seq", "date", F.lit("2024-01-03").cast("date")).select("doc_id", "channel")


@query("a22_nested_documents", f"WITH {POSTS}, {TAGS} SELECT ticker, count(*) AS n_items, CAST(max(date) AS VARCHAR) AS scrape_date, min(left(sha256(url), 16)) AS first_key FROM tagged WHERE date >= DATE '2024-02-01' GROUP BY ticker", dated=False)
def a22_documents(spark, sf_dir):
    df = tagged(spark, sf_dir).withColumn("url_hash", text.hash_key(F.col("url")))
    out = text.documents(text.retain(df, "date", F.lit("2024-02-01").cast("date")), "ticker", "url_hash", ["url", "score"], "date")
    return out.groupBy("ticker").agg(F.sum(F.size("items")).alias("n_items"), F.max("scrape_date").cast("string").alias("scrape_date"), F.min(F.array_min(F.map_keys("items"))).alias("first_key"))


@query("j7_u3_page_texts", r"""WITH t AS (SELECT url, max(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'))) AS content FROM pages WHERE url IS NOT NULL GROUP BY url)
SELECT page_id, pages.url, content FROM pages LEFT JOIN t USING (url)""", dated=False)
def j7_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    read = lambda urls: urls.join(pages.select("url", "html"), "url").groupBy("url").agg(F.max(text.page_text(F.col("html"))).alias("content"))
    return text.enrich_distinct(pages.select("page_id", "url"), "url", read)
