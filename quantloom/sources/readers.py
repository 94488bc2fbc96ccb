"""Sources: staged tables, text bars, symbol folders, nested JSON listings and alias files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.operators.clean import typed


def read_staged(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of ``schema`` if the path isn't there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars as text, coerced; what can't be read is null."""
    return typed(spark.read.csv(path, header=True))


def read_symbol_dirs(spark: SparkSession, root: str) -> DataFrame:
    """One table from folders ``symbol=...``; a filter on symbol reads its folders only. Folders are listed by a few tasks a core, where
    Spark would have a task a folder, up to 10,000; its limit is as before afterwards."""
    limit = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    own = spark.conf.get(limit)
    spark.conf.set(limit, str(min(int(own), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.option("basePath", root).parquet(root)
    finally:
        spark.conf.set(limit, own)


_POST = "data struct<title:string,selftext:string,score:bigint,num_comments:bigint,created_utc:double,permalink:string,subreddit:string>"
LISTING = f"data struct<children:array<struct<{_POST.replace('data struct', 'data:struct', 1)}>>>"


def posts_from_listing(spark: SparkSession, path: str, cutoff, multi_line: bool = True) -> DataFrame:
    """Posts of ``data.children[].data`` from ``cutoff`` (a timestamp column) on, with absolute links. A file is one
    listing, or one a line without ``multi_line``."""
    rows = spark.read.schema(LISTING).option("multiLine", multi_line).json(path).select(F.explode("data.children.data").alias("p")).select("p.*")
    ts = F.timestamp_seconds("created_utc")
    link = F.concat(F.lit("https://www.reddit.com"), "permalink")
    return rows.select("title", F.col("selftext").alias("body"), "score", "num_comments", ts.alias("ts"), link.alias("url"), "subreddit").where(F.col("ts") >= cutoff)


def news_from_items(df: DataFrame, raw: str = "raw") -> DataFrame:
    """News from JSON text in either shape: nested under content, or flat; items without title, link or time go."""
    get = lambda p: F.get_json_object(raw, p)
    ts = F.coalesce(F.try_to_timestamp(get("$.content.pubDate"), F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.timestamp_seconds(get("$.providerPublishTime").try_cast("bigint")))
    out = df.withColumns({"title": F.coalesce(get("$.content.title"), get("$.title")), "url": F.coalesce(get("$.content.canonicalUrl.url"), get("$.link")), "source": F.coalesce(get("$.content.provider.displayName"), get("$.publisher")), "ts": ts})
    return out.where("title is not null and url is not null and ts is not null")


def alias_dim(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """(ticker, name, sector, term) from a JSON object of tickers (a file, or a line without ``whole_file``); empty if the file is missing or invalid."""
    schema = "ticker string, name string, sector string, term string"
    try:
        text = spark.read.text(path, wholetext=whole_file)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    parsed = F.from_json("value", "map<string,struct<name:string,sector:string,aliases:array<string>>>")
    rows = text.select(F.explode(parsed).alias("ticker", "v"))
    terms = F.array_distinct(F.concat(F.array("v.name"), F.coalesce("v.aliases", F.array().cast("array<string>"))))
    return rows.select("ticker", "v.name", "v.sector", F.explode(terms).alias("term")).where("term is not null and trim(term) <> ''")


def company_names(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """The alias name of a ticker, else the ticker itself; GENERAL is General."""
    names = aliases.groupBy("ticker").agg(F.first("name").alias("__name"))
    return df.join(names, "ticker", "left").withColumn("company_name", F.when(F.col("ticker") == "GENERAL", "General").otherwise(F.coalesce("__name", "ticker"))).drop("__name")
