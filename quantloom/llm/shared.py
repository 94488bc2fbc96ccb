"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.tables import cut, new_path, remove_tables, shared_dir  # noqa: F401

#: A table is broadcast only while its measured size is below this many bytes.
BROADCAST_BYTES = 32 << 20
#: Parts that the rows of a hot key are dealt to, each with its own copy of the key's row on the other side.
SALTS = 16
#: Bytes of text that a Python worker turns into objects at a time.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters.
BLANK = " \t\n\x0b\x0c\r"


def fits(size: int) -> bool:
    """Whether so many measured bytes may be broadcast."""
    return size <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """A broadcast hint if the measured rows times ``row_bytes`` stay below BROADCAST_BYTES;
    otherwise ``df`` as it is, for a shuffled join. ``df`` should be a table made by cut()."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if fits(rows * row_bytes) else df


def join_hot(df: DataFrame, keyed: DataFrame, on: list[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """Join of ``df``, whose keys may be hot, with ``keyed``, a table of one row a key that has few of them:
    a broadcast if that is small, else a shuffle in which the rows of a key go to SALTS
    parts and the key's row to each of them, so that no task gets a hot key whole."""
    rows = keyed.count()
    if fits(rows * row_bytes):
        return df.join(F.broadcast(keyed), on, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def repeated(df: DataFrame, *cols: str) -> DataFrame:
    """What stands on several rows: the non-null ``cols``, written as a table; counts are pre-aggregated."""
    return cut(df.select(*cols).na.drop().groupBy(*cols).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeated")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about 8 MB, as a worker holds two of them and each row may have a long text. Where the user has set
    a bound of bytes, that stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: int | str | Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of an Arrow batch with SLICE_BYTES of text in ``column`` at most, or one row.
    Spark itself ends a batch at spark.sql.execution.arrow.maxBytesPerBatch."""
    text = column(batch) if callable(column) else batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() does that on plain ASCII, quickly;
    other texts go through translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def whole(c: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(c), F.lit(""))


def smallest_hashes(df: DataFrame, key: str, n: int, rows: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest hashes of ``key``. Of a large table only about 1.2 n rows
    pass a first filter by hash, so what meets in one task doesn't grow with the partitions."""
    rows = df.count() if rows is None else rows
    h = F.xxhash64(key).bitwiseAND((1 << 62) - 1)
    if rows > 2 * n:
        df = df.where(h < int((1 << 62) * 1.2 * n / rows))
    return df.orderBy(h, key).limit(n)
