"""Structured Streaming forms of the ingest and change-detection jobs."""

from __future__ import annotations

import hashlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quantloom.functions.tables import cut
from quantloom.operators.changes import actionable, diff_snapshots, hash_tree
from quantloom.sources.sinks import Once, _publish, current, drain, merge_stage, stage


#: Keyed state of several kinds needs this state store.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(sdf: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return sdf.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _name(checkpoint: str) -> str:
    """A stream's name: batches are numbered within a checkpoint."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def stream_bars(sdf: DataFrame, target: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """Bars without repeats within the watermark, upserted by (symbol, date). A batch rewrites the
    months that it has rows of, and one that runs again after a failure gives the same table. It is written before it is merged, as each job on
    a batch would go through its keys' state again. Spark's default store has a batch's keys in the executors' heaps; RocksDB, if the user sets it, on their disks."""
    fresh = sdf.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "date"])
    month = F.date_format("date", "yyyy-MM")
    return _run(fresh, lambda batch, _: merge_stage(cut(batch, "fresh"), target, ["symbol", "date"], ["ts"], month) and None, checkpoint)


def daily_counts(sdf: DataFrame, late: str = "7 days") -> DataFrame:
    """Items a day and key; items later than the watermark are dropped."""
    return sdf.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "ticker").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_sentiment(sdf: DataFrame, days: int = 7, late: str = "7 days") -> DataFrame:
    """Equal-weight mean and positive share over ``days`` (3 or 7), every day; items later than the watermark are dropped."""
    window = F.window("ts", f"{days} days", "1 day").alias("span")
    return sdf.withWatermark("ts", late).groupBy(window, "ticker").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("value") > 0.1).cast("double")).alias("pos_share"))


def stream_changes(sdf: DataFrame, state: str, on_change: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each batch is a snapshot (sheet, row_no, row_hash). The first one only becomes the state; later ones
    are compared with it, actionable changes are handed on, and only then the state moves, so a
    failed hand-over is tried again. The state's hash tree is kept beside it, so of the state only rows under unequal blocks are read, and
    a snapshot of equal hashes isn't written again."""

    def each(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        rows, tree = cut(batch.select("sheet", "row_no", "row_hash"), "snapshot"), f"{state}-tree"
        after, old, before = cut(hash_tree(rows), "tree"), current(spark, state), current(spark, tree)
        if old is not None and before is not None:
            if before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty():
                return
            changes = actionable(diff_snapshots(old, rows, before, after))
            if not changes.isEmpty():
                on_change(changes)
        _publish(rows, state)
        _publish(after, tree)

    return _run(sdf, each, checkpoint)


class _LastDate(StatefulProcessor):
    """The last date of one symbol, as a value state; a row comes out when it moves."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "last_date date")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = max((pdf["date"].max() for pdf in rows), default=None)
        before = self.state.get()[0] if self.state.exists() else None
        if last is not None and (before is None or last > before):
            self.state.update((last,))
            yield pd.DataFrame({"symbol": [key[0]], "last_date": [last]})

    def close(self) -> None:
        pass


def last_dates(sdf: DataFrame) -> DataFrame:
    """Rows (symbol, last_date) each time that a symbol's last date moves on, from keyed state; a late row never moves it back. A task has the
    state of its symbols in a store that is part of the checkpoint, so a restart goes on from there. Rows are pre-aggregated before they are dealt by symbol, so that
    a symbol with most of them isn't much to its task. Rows without date tell nothing; those without symbol are left out."""
    spark = sdf.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    kind = sdf.schema["symbol"].dataType.simpleString()

    def latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = pa.table(batch).group_by("symbol").aggregate([("date", "max")]).select(["symbol", "date_max"]).rename_columns(["symbol", "date"])
            yield from last.to_batches()

    rows = sdf.where("symbol is not null and date is not null").select("symbol", F.col("date").cast("date").alias("date")).mapInArrow(latest, f"symbol {kind}, date date")
    return rows.groupBy("symbol").transformWithStateInPandas(_LastDate(), f"symbol {kind}, last_date date", "Update", "None")


def stream_watermarks(sdf: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The last date seen by symbol, from keyed state (last_dates). A batch writes only the symbols whose date moves, once, as a folder of its own; ``watermarks``
    reads the table."""
    table = Once(target)
    return _run(last_dates(sdf), lambda batch, k: table.write(batch, f"{_name(checkpoint)}-{k}") and None, checkpoint, mode="update")


def watermarks(spark: SparkSession, target: str) -> DataFrame | None:
    """The table of stream_watermarks: a row a symbol; None before its first batch."""
    rows = Once(target).rows(spark)
    return rows.groupBy("symbol").agg(F.max("last_date").alias("last_date")) if rows is not None else None


class _Lots(StatefulProcessor):
    """Of a bucket of symbols, the trades that no trade of the other side has met yet, oldest first: a map state from a symbol to their side, and their quantities and
    prices as packed doubles. A list state would hand over each lot on its own, in and out, and a group a symbol costs more than its trades."""

    def __init__(self, kind: str) -> None:
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("open", f"symbol {self.kind}", "side string, lots binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        trades = defaultdict(list)
        for pdf in rows:
            for symbol, *trade in zip(*(pdf[c].tolist() for c in ("symbol", "seq", "side", "qty", "price"))):
                trades[symbol].append(trade)
        out = []
        for symbol, batch in trades.items():
            before = self.state.getValue((symbol,))
            held, lots = (before[0], deque(np.frombuffer(before[1]).reshape(-1, 2).tolist())) if before else (None, deque())
            done = pnl = 0.0
            for _, side, qty, price in sorted(batch, key=lambda t: t[0]):
                while qty > 0 and lots and held != side:
                    there, at = lots.popleft()
                    part = min(qty, there)
                    done, pnl, qty = done + part, pnl + part * ((price - at) if side == "sell" else (at - price)), qty - part
                    if there > part:
                        lots.appendleft([there - part, at])
                if qty > 0:
                    held = side
                    lots.append([qty, price])
            if lots:
                self.state.updateValue((symbol,), (held, np.array(lots, "f8").tobytes()))
            elif before:
                self.state.removeKey((symbol,))
            if done:
                out.append((symbol, done, pnl))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "qty", "pnl"])

    def close(self) -> None:
        pass


def realised_lots(sdf: DataFrame, buckets: int = 1024) -> DataFrame:
    """What each batch of trades (symbol, side buy or sell, qty, price, seq) realises by symbol, as metrics.fifo_pnl() has it over all of them: the sum of
    qty and pnl is the same however trades are cut into batches, in order of seq. Open lots are a map state, a value a symbol, of one side at a time, so a batch meets what is open and no earlier
    trade is read again. Symbols are dealt to ``buckets`` keys of the state, which stay the same for a checkpoint; a bucket's trades of one batch are its task's at once, so there should be
    buckets enough for a batch. Rows without symbol, or with a null, are left out."""
    spark = sdf.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    kind = sdf.schema["symbol"].dataType.simpleString()
    rows = sdf.select("symbol", "side", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"), "seq").na.drop()
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Lots(kind), f"symbol {kind}, qty double, pnl double", "Update", "None")


def stream_lots(sdf: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Realised quantities and profits, each batch's once; ``profits`` reads their sums."""
    table = Once(target)
    return _run(realised_lots(sdf), lambda batch, k: table.write(batch, f"{_name(checkpoint)}-{k}") and None, checkpoint, mode="update")


def profits(spark: SparkSession, target: str) -> DataFrame | None:
    rows = Once(target).rows(spark)
    return rows.groupBy("symbol").agg(F.sum("qty").alias("qty"), F.sum("pnl").alias("pnl")) if rows is not None else None


def stream_inbox(sdf: DataFrame, inbox: str, keys: list[str], order: list[str | Column], sink: Callable[[DataFrame], bool] | Once, checkpoint: str) -> StreamingQuery:
    """Batches join what is retained; a sink that fails (returns False) leaves all for the next batch. A batch is staged under the stream's name and its number, so that
    one which runs again after a failure isn't staged again; with a Once table each row is delivered once wherever the run fails."""
    whole = sink if isinstance(sink, Once) else lambda df: df.count() if sink(df) else -1

    def each(batch: DataFrame, k: int) -> None:
        stage(batch, inbox, replace=False, name=f"{_name(checkpoint)}-{k}")
        drain(batch.sparkSession, inbox, whole, keys, order)

    return _run(sdf, each, checkpoint)
