"""Sinks: an inbox of staged batches, upserted tables, aligned appends, per-symbol files and nested documents.

A Spark job can't overwrite what it reads, so data goes to new folders, and small log rows
then say which folders count. What a failed job leaves is never named by the log. A root has one writer at a time, as log rows
are numbered by those there are; readers may come at any time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.scalars import last_by
from quantloom.functions.tables import remove

#: Rows of a part that one task merges and writes as a file.
SLICE_ROWS = 1 << 18

_LOG = "folder string, part string, seq long, live boolean"
_ATTEMPTS = "delivery string, folders array<string>, open boolean"
_LEDGER = "delivery string, n long"


def _rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small table that rows are appended to; empty if it isn't there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _append(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> None:
    """Rows in one file, so that they count together."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _log(spark: SparkSession, root: str) -> DataFrame:
    """The log of a root: one row a change of a folder; empty if there is none."""
    return _rows_of(spark, f"{root}/_log", _LOG)


def _append_log(spark: SparkSession, root: str, rows: list[tuple[str, str, bool]]) -> None:
    """Rows (folder, part, live), all with the next number of the log, in one file, so that they count together."""
    seq = (_log(spark, root).agg(F.max("seq")).first()[0] or 0) + 1
    _append(spark, f"{root}/_log", _LOG, [(f, p, seq, live) for f, p, live in rows])


def _batches(spark: SparkSession, root: str) -> list[str]:
    """Staged folders that aren't delivered yet, in order."""
    rows = _log(spark, root).groupBy("folder").agg(F.min("seq").alias("seq"), F.bool_and("live").alias("live")).where("live")
    return [r["folder"] for r in rows.orderBy("seq", "folder").collect()]


def _union(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    parts = [spark.read.parquet(f"{root}/{f}").withColumn("_batch", F.lit(k)) for k, f in enumerate(folders)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _last(rows: DataFrame, keys: list[str] | None, order: Iterable[str]) -> DataFrame:
    """The last row of each key, by those keys that the rows have; all rows where they have none."""
    keys = [k for k in keys or [] if k in rows.columns]
    return last_by(rows, keys, list(order)) if keys else rows


def stage(df: DataFrame, root: str, replace: bool = True, name: str | None = None) -> bool:
    """A new pending batch, in place of those before it or (``replace`` off) behind them; nothing without rows. A batch with
    a ``name`` is staged once: again under that name, whether it waits or was delivered, it changes nothing."""
    if df.isEmpty():
        return False
    spark, folder = df.sparkSession, f"b-{name or uuid.uuid4().hex}"
    if name and not _log(spark, root).where(F.col("folder") == folder).isEmpty():
        return False
    old = _batches(spark, root) if replace else []
    df.write.mode("overwrite").parquet(f"{root}/{folder}")
    _append_log(spark, root, [(folder, "", True), *((f, "", False) for f in old)])
    return True


def pending(spark: SparkSession, root: str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame | None:
    """All rows that wait, or None. With ``keys`` the last of each counts, later batches over earlier ones; keys that no batch has don't
    count, and rows of a batch without one that others have are null there."""
    folders = _batches(spark, root)
    return _last(_union(spark, root, folders), keys, ["_batch", *(order or [])]).drop("_batch") if folders else None


class Once:
    """A table that takes each delivery once, told apart by its id: rows go to the delivery's own folder, which only a row of a ledger
    makes count. Written again after a failure, a folder is replaced; an id in the ledger is left as it is."""

    def __init__(self, root: str) -> None:
        self.root = root

    def deliveries(self, spark: SparkSession) -> dict[str, int]:
        """The rows of each delivery that counts."""
        return {r["delivery"]: r["n"] for r in _rows_of(spark, f"{self.root}/_ledger", _LEDGER).collect()}

    def write(self, df: DataFrame, delivery: str) -> int:
        """The rows that the delivery has, whether now or by an earlier call."""
        spark, folder = df.sparkSession, f"{self.root}/d-{delivery}"
        n = self.deliveries(spark).get(delivery)
        if n is None:
            df.write.mode("overwrite").parquet(folder)
            n = spark.read.parquet(folder).count()
            _append(spark, f"{self.root}/_ledger", _LEDGER, [(delivery, n)])
        return n

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """What was delivered; None before the first delivery."""
        done = sorted(self.deliveries(spark))
        return spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/d-{d}" for d in done]) if done else None


def _attempt(spark: SparkSession, root: str) -> tuple[str, list[str]] | None:
    """The delivery that was begun and isn't known to have ended."""
    rows = _rows_of(spark, f"{root}/_attempts", _ATTEMPTS).groupBy("delivery").agg(F.first("folders").alias("folders"), F.bool_and("open").alias("open")).where("open").collect()
    return next(((r["delivery"], r["folders"]) for r in rows), None)


def _hand_over(spark: SparkSession, root: str, sink: Callable[[DataFrame], int] | Once, delivery: str, folders: list[str], keys: list[str] | None, order: list[str] | None) -> int:
    rows = _last(_union(spark, root, folders), keys, ["_batch", *(order or [])]).drop("_batch")
    n = rows.count()
    written = sink.write(rows, delivery) if isinstance(sink, Once) else sink(rows)
    if written == n:
        _append_log(spark, root, [(f, "", False) for f in folders])
    return written


def drain(spark: SparkSession, root: str, sink: Callable[[DataFrame], int] | Once, keys: list[str] | None = None, order: list[str] | None = None) -> int | None:
    """Hand what waits to ``sink``; just those batches are done if it wrote all their rows, so a batch staged meanwhile
    waits on. None if nothing waits.

    A function may get rows again when the run fails between its return and the note that they are done. A Once table gets each row once: which batches
    go under which id is noted before, and a run that finds such a note without its end hands over just those batches under that
    id again, which the table knows, before it turns to what was staged since."""
    ours, written = isinstance(sink, Once), None
    if ours and (begun := _attempt(spark, root)):
        delivery, folders = begun
        if set(folders) <= set(_batches(spark, root)):  # else only the note of its end is missing
            written = _hand_over(spark, root, sink, delivery, folders, keys, order)
        _append(spark, f"{root}/_attempts", _ATTEMPTS, [(delivery, folders, False)])
    folders = _batches(spark, root)
    if not folders:
        return written
    delivery = uuid.uuid4().hex
    if ours:
        _append(spark, f"{root}/_attempts", _ATTEMPTS, [(delivery, folders, True)])
    more = _hand_over(spark, root, sink, delivery, folders, keys, order)
    if ours:
        _append(spark, f"{root}/_attempts", _ATTEMPTS, [(delivery, folders, False)])
    return more + (written or 0)


def collect(spark: SparkSession, root: str, fetch: Callable[[], DataFrame], sink: Callable[[DataFrame], int] | Once, enabled: bool = True, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame | None:
    """One ingest run: drain what waits, then, if collection is on, stage what ``fetch`` brings behind
    what a failed sink left; returns what waits now. Nothing retained is lost, whether a sink fails or not."""
    drain(spark, root, sink, keys, order)
    if enabled:
        stage(fetch(), root, replace=False)
    return pending(spark, root, keys, order)


def _current(spark: SparkSession, root: str) -> dict[str, str]:
    """The folder that counts for each part of a merged table."""
    last = _log(spark, root).groupBy("part").agg(F.max_by("folder", F.struct("seq", "folder")).alias("folder"))
    return {r["part"]: r["folder"] for r in last.collect()}


def current(spark: SparkSession, root: str, parts: list[str] | None = None) -> DataFrame | None:
    """The rows of a merged table that count, or those of some parts; None if there are none."""
    folders = {p: f for p, f in _current(spark, root).items() if parts is None or p in parts}
    # Batches may differ in columns, so the folders' schemas are merged where there are several.
    reader = spark.read.option("mergeSchema", len(set(folders.values())) > 1)
    return reader.parquet(*[f"{root}/{f}/_part={p}" for p, f in sorted(folders.items())]) if folders else None


def _part(part: Column | None) -> Column:
    return F.lit("all") if part is None else F.coalesce(part.cast("string"), F.lit("none"))


def _publish(df: DataFrame, root: str, part: Column | None = None) -> int:
    spark, folder = df.sparkSession, f"v-{uuid.uuid4().hex}"
    rows = df if "_part" in df.columns else df.withColumn("_part", _part(part))
    # Few files a part; Spark splits a part that is too large for one task. Rows that have their part are placed.
    (rows if part is None or "_part" in df.columns else rows.hint("rebalance", "_part")).write.partitionBy("_part").parquet(f"{root}/{folder}")
    parts = [r[0] for r in spark.read.parquet(f"{root}/{folder}").select(F.col("_part").cast("string")).distinct().collect()]
    _append_log(spark, root, [(folder, p, True) for p in parts])
    return spark.read.parquet(f"{root}/{folder}").count() if parts else 0


def merge_stage(df: DataFrame, root: str, keys: list[str], order: list[str], part: Column | None = None) -> int:
    """Upsert into a merged table: the last of each key wins, fresh rows over retained ones.

    Keys are those that fresh or retained rows have; rows of the side that lacks one are null there, and meet only
    rows that are null there too. Where neither side has any, no row replaces another. With ``part``, an expression over the keys such as a month, only the parts that ``df`` has rows
    of are read and written anew, and rows are dealt once, by part and slices of its keys, to be merged and written. ``df`` is gone through twice.
    Returns the number of rows written."""
    spark = df.sparkSession
    counted = lambda t: {r["p"]: r["n"] for r in t.groupBy(_part(part).alias("p")).agg(F.count("*").alias("n")).collect()}
    touched = counted(df)
    if not touched:
        return 0
    old = current(spark, root, list(touched))
    rows = df.withColumn("__batch", F.lit(1))
    rows = rows if old is None else old.withColumn("__batch", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    own = [k for k in keys if k in rows.columns]
    if part is None or not own:
        return _publish(_last(rows, keys, ["__batch", *order]).drop("__batch"), root, part)
    kept = counted(old) if old is not None else {}
    slices = {p: -(-(n + kept.get(p, 0)) // SLICE_ROWS) for p, n in touched.items()}
    rows = rows.withColumns({"_part": _part(part), "__slice": F.pmod(F.xxhash64(*own), F.lit(max(slices.values()))).cast("int")})
    n = sum(slices.values())
    rows = rows.repartition(*([n] if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else []), "_part", "__slice")
    return _publish(_last(rows, ["_part", "__slice", *own], ["__batch", *order]).drop("__batch", "__slice"), root, part)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the folders of a merged table or an inbox that no longer count, when no job reads them; returns their number."""
    rows = _log(spark, root).groupBy("folder").agg(F.max("part").alias("part"), F.bool_and("live").alias("live")).collect()
    kept = set(_current(spark, root).values())
    old = [r["folder"] for r in rows if (r["folder"] not in kept if r["part"] else not r["live"])]
    for folder in old:
        remove(spark, f"{root}/{folder}")
    return len(old)


def replace_latest(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Only the latest row of each key."""
    last_by(df, keys, order).write.mode("overwrite").parquet(path)


def append_aligned(df: DataFrame, path: str, columns: list[str], defaults: dict[str, object]) -> None:
    """Append with the target's columns by name, in any case, and defaults where there is nothing."""
    have = {c.lower(): c for c in df.columns}
    value = lambda c: F.coalesce(F.col(have[c.lower()]), F.lit(defaults.get(c))) if c.lower() in have else F.lit(defaults.get(c, ""))
    df.select(*[value(c).alias(c) for c in columns]).write.mode("append").parquet(path)


def write_results(predictions: DataFrame, metrics: DataFrame, path: str) -> None:
    """Predictions as CSV, metrics as JSON; the commit protocol makes each whole or absent."""
    predictions.write.mode("overwrite").option("header", True).csv(f"{path}/predictions")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def write_features(df: DataFrame, path: str) -> None:
    """A folder a symbol. Rows are dealt by symbol first, so each folder has few files."""
    df.repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """Nested documents as JSON lines; rows without key are left out."""
    df.where(F.col(key).isNotNull()).write.mode("overwrite").json(path)
