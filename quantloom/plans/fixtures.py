"""Market-shaped tables derived from the given ones, for Spark and, as common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.tables import cut, new_path, parts_of
from quantloom.operators.bars import bars_from_trades

SEQ = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, symbol: str = "l_suppkey") -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.expr(symbol).alias("symbol"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), F.struct(*SEQ).alias("seq"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many symbols with hardly more than a trade a day."""
    return bars_from_trades(trades(spark, sf_dir), parts_of(table(spark, sf_dir, "lineitem")))


def deep_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few symbols with many trades a day, so that ranges are real."""
    return bars_from_trades(trades(spark, sf_dir, "l_suppkey % 5"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    return t.groupBy("date").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("mkt_close"), F.stddev_samp(F.col("l_extendedprice") / F.col("l_quantity")).alias("vol_close"))


_ORDER = ", ".join(SEQ)


def _bars_sql(symbol: str, name: str) -> str:
    return f"""{name} AS (SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date, first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""


def ema_sql(name: str, span: int, src: str = "num", x: str = "close") -> str:
    """An exponential mean as a recursive table (symbol, n, x, y) over numbered rows."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"""{name} AS (SELECT symbol, n, {x} AS x, {x} AS y FROM {src} WHERE n = 1 UNION ALL
  SELECT b.symbol, b.n, b.{x}, {a} * b.{x} + (1 - {a}) * e.y FROM {name} e JOIN {src} b ON b.symbol = e.symbol AND b.n = e.n + 1)"""


NUMBERED = "num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars)"
EMA_ROWS = f"{NUMBERED}, {ema_sql('e12', 12)}, {ema_sql('e26', 26)}, {ema_sql('e50', 50)}"
MACD_ROWS = f"{EMA_ROWS}, m AS (SELECT a.symbol, a.n, a.y - b.y AS close FROM e12 a JOIN e26 b ON a.symbol = b.symbol AND a.n = b.n), {ema_sql('s', 9, 'm')}"
BARS = _bars_sql("l_suppkey", "bars")
DEEP = _bars_sql("l_suppkey % 5", "bars")
INDEX = """idx AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS mkt_close,
  stddev_samp(l_extendedprice / l_quantity) AS vol_close FROM lineitem GROUP BY 1)"""


def feed(spark: SparkSession, parts: list[DataFrame], label: str, path: str | None = None, done: int = 0) -> DataFrame:
    """The parts as equal numbers of files, as many as shuffles have partitions, that a stream takes a part a batch, in order of their times. Parts behind
    the ``done`` ones that ``path`` has already are for a stream that goes on from a checkpoint. Each is made once; where one has too few rows for its files, all
    are written again, in order, in that number."""
    path, schema = path or new_path(spark, label), parts[0].schema
    at = [f"{path}/{k}" for k in range(done, done + len(parts))]
    for df, p in zip(parts, at):
        df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(p)
    count = lambda p: len(spark.read.schema(schema).parquet(p).inputFiles())
    while len(files := {count(p) for p in at}) > 1:
        for p in at:
            cut(spark.read.schema(schema).parquet(p), label).repartition(min(files)).write.mode("overwrite").parquet(p)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files.pop()).option("recursiveFileLookup", True).parquet(path)
