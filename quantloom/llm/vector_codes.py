"""Compression of vectors to codes of their parts' nearest codebook entries, found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shared import cut, join_hot, small_batches
from quantloom.llm.vectors import finite, matrix, width

#: Components scaled to whole numbers must be below this, so that squared distances of parts are exact in 64 bits.
MOST = 1 << 22
#: Rows that a worker searches at a time.
ROWS = 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the entry nearest to each row, ties to the lower one, and its squared distance; whole numbers.

    Entries are sorted by their component sums. From a row's own sum the search goes outward to both sides; a side
    ends where the squared gap of sums over the dimension is strictly above the least distance so far, as no entry from there on is
    nearer or as near (by the inequality of Cauchy and Schwarz).
    """
    wide = x.shape[1]
    order = np.argsort(book.sum(1), kind="stable")
    sums, own = book.sum(1)[order], x.sum(1)
    first = np.minimum(np.searchsorted(sums, own), len(book) - 1)
    at = order[first]
    best = ((x - book[at]) ** 2).sum(1)
    sides = []
    for step in (-1, 1):
        place = first + step
        sides.append((step, place, np.flatnonzero((place >= 0) & (place < len(book)))))
    while any(len(rows) for _, _, rows in sides):
        for k, (step, place, rows) in enumerate(sides):
            rows = rows[(own[rows] - sums[place[rows]]) ** 2 <= best[rows] * wide]
            entry = order[place[rows]]
            far = ((x[rows] - book[entry]) ** 2).sum(1)
            better = (far < best[rows]) | (far == best[rows]) & (entry < at[rows])
            best[rows[better]], at[rows[better]] = far[better], entry[better]
            place[rows] += step
            sides[k] = (step, place, rows[(place[rows] >= 0) & (place[rows] < len(book))])
    return at, best


def _whole(column: pa.Array, wide: int, scale: int) -> np.ndarray:
    x = np.floor(scale * matrix(column, wide))
    if x.size and np.abs(x).max() >= MOST:
        raise ValueError(f"components of {MOST / scale:g} or more")
    return x.astype("i8")


def _assign(batch: pa.RecordBatch, books: np.ndarray, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with their parts (rows, parts, part's width), entries and distances (rows, parts)."""
    parts, _, wide = books.shape
    for at in range(0, batch.num_rows, ROWS):
        rows = batch.slice(at, ROWS)
        x = _whole(rows.column(rows.num_columns - 1), parts * wide, scale).reshape(-1, parts, wide)
        found = [nearest(x[:, p], books[p]) for p in range(parts)]
        yield rows, x, np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def fit(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """Codebooks (parts, entries, width of a part) of whole numbers, fitted on all vectors of ``df``, which must be finite.

    They start as the parts of the ``entries`` vectors with the smallest ids (null ids last, rows of one id by their vectors; fewer
    where there are fewer). In each round a task sums its rows by part and entry, and only those sums meet; of them a codebook's size
    reaches the driver. An entry becomes its rows' rounded-down mean, unused ones stay.
    """
    small_batches(df.sparkSession)
    wide = width(df, vector_col)
    if wide % parts:
        raise ValueError(f"vectors of {wide} entries can't be cut into {parts} equal parts")
    vector = F.col(vector_col).alias("vector")
    first = df.select(F.col(id_col).alias("id"), vector).orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    books = np.stack([_whole(pa.array([r["vector"]], pa.list_(pa.float64())), wide, scale).reshape(parts, -1) for r in first], 1) if first and wide else np.zeros((parts, 0, wide // parts), "i8")
    n, w = books.shape[1:]
    if not n:
        return books

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            counts, totals = np.zeros(parts * n, "i8"), np.zeros((parts * n, w), "i8")
            for batch in batches:
                for _, x, entry, _ in _assign(batch, books, scale):
                    cell = (entry + np.arange(parts) * n).ravel()
                    counts += np.bincount(cell, minlength=parts * n)
                    for c in range(w):  # whole numbers far below 2^53, so sums of doubles are exact
                        totals[:, c] += np.bincount(cell, x[:, :, c].ravel(), parts * n).astype("i8")
            used = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(used), pa.array(counts[used]), pa.array(list(totals[used]), pa.list_(pa.int64()))], names=["cell", "n", "total"])

        met = df.select(vector).mapInArrow(sums, "cell long, n long, total array<long>")
        met = met.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[c]) for c in range(w)]).alias("total"))
        books = books.copy()
        for r in met.collect():
            books[r["cell"] // n, r["cell"] % n] = [t // r["n"] for t in r["total"]]
    return books


def encode(df: DataFrame, books: np.ndarray, vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Adds ``code``, the parts' entries as two hex digits each, and ``error``, their squared distances added up, to rows with finite vectors;
    the vector goes, other columns stay but for ones of these names."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in (vector_col, "code", "error")]
    if books.shape[1] > 256:
        raise ValueError("codes have two hex digits a part, so 256 entries at most")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, entry, far in _assign(batch, books, scale):
                code = [r.tobytes().hex() for r in entry.astype("u1")]
                yield pa.record_batch([rows.column(0), pa.array(code, pa.string()), pa.array(far.sum(1))], names=["row", "code", "error"])

    rows = df.select(F.struct(*names).alias("row"), F.col(vector_col).alias("vector"))
    return rows.mapInArrow(assign, f"row {rows.schema['row'].dataType.simpleString()}, code string, error long").select("row.*", "code", "error")


def digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components as decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Codes of all rows whose vector is there and finite, with codebooks fitted on all of them, ``label_error``, the errors added
    up over equal labels (nulls together), and ``codebooks_sha256``.

    Rows with a null vector, or a null or non-finite component, go; null ids and labels stay, repeated rows each count. Vectors of unequal lengths,
    of a length that the parts don't divide, or with components beyond 2^22 / ``scale`` are an error. An empty table gives an empty one. Other columns stay but for
    ones with the results' names. The vectors are read once a round and once at the end; labels are pre-aggregated, so a hot one is a few rows.
    """
    kept = df.where(finite(vector_col)).drop("code", "error", "label_error", "codebooks_sha256")
    books = fit(kept, vector_col, id_col, parts, entries, rounds, scale)
    key = {"_label": F.md5(F.coalesce(F.col(label_col).cast("string"), F.lit(""))), "_blank": F.col(label_col).isNull()}
    out = cut(encode(kept, books, vector_col, scale).withColumns(key), "codes")
    sums = cut(out.groupBy("_label", "_blank").agg(F.sum("error").alias("label_error")), "label-errors")
    return join_hot(out, sums, ["_label", "_blank"], 80).drop("_label", "_blank").withColumn("codebooks_sha256", F.lit(digest(books)))
