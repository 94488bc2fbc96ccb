"""Written tables in the shared folder, and exact ranks without one large task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a temporary folder is set for a local master (one machine, as in
    tests); on a cluster that is an error, as executors don't see each other's disks.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the run's own folder, quantloom-<application id>, of the shared one."""
    return f"{shared_dir(spark)}/quantloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_tables(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder, once no result that is still to be read needs it."""
    remove(spark, new_path(spark, "x").rsplit("/", 1)[0])


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: later stages start from
    files that survive a lost executor, and nothing above is computed twice."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, rows: int = 1 << 18) -> int:
    """How many partitions ``df`` needs for ``rows`` rows each, those of a shuffle at least: a task's memory stays the same
    however large the table is. Counting a table of files reads their footers only."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def ranked(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """Adds ``rank``, the rows (or the ``weight``) before a row within ``keys`` by ``order``, and ``total``, all of them, however few keys there are.

    Rows are range-partitioned by keys and order, which should be total, each range is summed up by key, and a
    range's rows are ranked on their own and moved up by the ranges before it. Ranges are written
    first, so that summing and ranking see the same ones. Rows with a null key are left out."""
    placed = df.repartitionByRange(*keys, *order)
    if not weight:  # Sorted ranges are numbered as they are written (partition and row, in one number), so rows are shuffled once.
        placed = placed.sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
        placed = cut(placed, "ranges").withColumns({"_range": F.shiftright("_at", 33), "_own": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")
        sizes = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_own").alias("_first"))
    else:
        placed = cut(placed.withColumn("_range", F.spark_partition_id()), "ranges")
        sizes = placed.groupBy(*keys, "_range").agg(F.sum(weight).alias("_n"), F.lit(0).cast("long").alias("_first"))
        inside = Window.partitionBy(*keys, "_range").orderBy(*order)
        placed = placed.withColumn("_own", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumns({"_before": F.coalesce(before, F.lit(0)) - F.col("_first"), "total": F.sum("_n").over(w)}).drop("_n", "_first")
    rows = placed.join(sizes, [*keys, "_range"])
    return rows.withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def median(df: DataFrame, value: str) -> DataFrame:
    """One row, one column of the value's name: the exact median of its non-null values, null without any.

    Approximate percentiles beside the middle bound it, values below them are counted, and only those between them are ranked, equal ones
    counted first, so that no value is hot. All are where the counts show that the middle isn't between. ``df`` is read
    three times, so it should be a written table."""
    rows = df.where(F.col(value).isNotNull()).select(value)
    x, skipped, n = F.col(value), F.lit(0), F.col("total")
    lo, hi = rows.agg(F.percentile_approx(value, [0.4995, 0.5005], 10000)).first()[0] or (None, None)
    if lo is not None:
        below, upto, every = rows.agg(F.count_if(x < lo), F.count_if(x <= hi), F.count("*")).first()
        if below <= (every - 1) // 2 and every // 2 < upto:
            rows, skipped, n = rows.where(x.between(lo, hi)), F.lit(below), F.lit(every)
    rows = ranked(rows.groupBy(value).agg(F.count("*").alias("times")), [], [value], "times").withColumn("rank", F.col("rank") + skipped)
    holds = lambda r: (F.col("rank") <= r) & (r < F.col("rank") + F.col("times"))
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    return rows.agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias(value))


#: A table is broadcast only while its measured rows, at ROW_BYTES each, stay below this many bytes.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 128
#: Parts that the rows of a hot key are dealt to.
SALTS = 16


def join_keyed(df: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of ``df``, whose keys may be hot, with ``keyed``, a written table of few rows a key: a broadcast while that is small, else a shuffle in which
    a key's rows go to SALTS parts, each with a copy of the key's rows on the other side."""
    if keyed.count() * ROW_BYTES <= BROADCAST_BYTES:
        return df.join(F.broadcast(keyed), on, how)
    salt = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]), F.lit(SALTS)).cast("int")
    salted = df.withColumn("_salt", salt)
    return salted.join(keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"], how).drop("_salt")


def tie_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, average, total) of the distinct non-null values within ``keys``, which have no nulls: their average rank from 1 on, and how many rows
    there are. Values are counted first and ranked by ranges, so neither a group nor a frequent value is one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("times"))
    rows = ranked(counts, keys, [value], "times")
    return rows.select(*keys, value, (F.col("rank") + (F.col("times") + 1) / 2.0).alias("average"), "total")
