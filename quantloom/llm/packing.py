"""Best-fit packing of documents into sequences, after dominance reduction."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import broadcast_if_small, cut, slices, small_batches, whole
from quantloom.llm.tokens import coder, default_path

#: Rows of one length and bucket that a task ranks together, about.
BUCKET_ROWS = 20_000


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Martello and Toth's reduction on a histogram: fix bins that dominate every other
    way to use their largest item, take their items from ``counts`` and repeat.

    For an item of length j with r = capacity - j left, let t be the largest item that fits:
    j alone is fixed if nothing fits; {j, t} if t = r, or no two items fit beside j, or
    two do at most and t is no less than any such two together; {j, a, b} if at most two
    fit, {a, b} is the fullest such pair, a = t and no pair's smaller item exceeds b.
    Equal items are fixed in one step. Returns (number of bins, ((length, items of it), ...)).
    """
    fixed = []

    def others(j: int) -> np.ndarray:
        counts[j] -= 1
        there = np.flatnonzero(counts[: capacity - j + 1])
        counts[j] += 1
        return there

    def fix(m: int, *items: int) -> None:
        for x in items:
            counts[x] -= m
        fixed.append((m, tuple((x, items.count(x)) for x in dict.fromkeys(items))))

    def most(*items: int) -> int:
        return min(int(counts[x]) // items.count(x) for x in items)

    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j] > 0:
                r, fits = capacity - j, others(j)
                if not len(fits):
                    fix(int(counts[j]) if 2 * j > capacity else 1, j)
                    changed = True
                    continue
                t, s = int(fits[-1]), int(fits[0])
                left = lambda x, j=j: int(counts[x]) - (x == j)
                small = [x for x in fits[:3].tolist() for _ in range(min(3, left(x)))][:3]
                if t == r or len(small) < 2 or small[0] + small[1] > r:
                    fix(max(1, most(j, t)), j, t)
                elif len(small) < 3 or sum(small) > r:
                    a, b, least = _pair(fits, left, r)
                    if t >= a + b:
                        fix(max(1, most(j, t)), j, t)
                    elif a == t and least <= b:
                        # The conditions see counts up to 3 beside j only, so they hold as they are while each is above.
                        fix(max(1, min((int(counts[x]) - 4) // (j, a, b).count(x) + 1 for x in (j, a, b))), j, a, b)
                    else:
                        break
                else:
                    break
                changed = True
                assert s > 0
    return fixed


def _pair(fits: np.ndarray, left, r: int) -> tuple[int, int, int]:
    """The fullest pair (a >= b) of two items that fit in r, and the largest smaller item of any pair."""
    best, least, lo, hi = (0, 0), 0, 0, len(fits) - 1
    while lo <= hi:
        b, a = int(fits[lo]), int(fits[hi])
        if a + b > r or (lo == hi and left(a) < 2):
            hi -= 1
            continue
        if (a + b, a) > (sum(best), best[0]):
            best = (a, b)
        least = max(least, b)
        lo += 1
    return *best, least


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing on a histogram: items of one length go together into the open bins of the
    least room that holds them. Bins with equal contents are one entry, so the work follows
    the number of lengths, not of items."""
    open_bins: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, items: tuple) -> None:
        if n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((n, items))

    for length in np.flatnonzero(counts)[::-1].tolist():
        c = int(counts[length])
        while c:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                room, n, items = capacity, c, ()
            else:
                room = rooms[k]
                n, items = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[k]
            each = room // length
            full = min(n, c // each)
            rest = c - full * each if full < n else 0
            rest = min(rest, each - 1)
            put(room - each * length, full, (*items, (length, each)))
            put(room - rest * length, 1 if rest else 0, (*items, (length, rest)))
            if items:
                put(room, n - full - (1 if rest else 0), items)
            c -= full * each + rest
    return [x for room in sorted(open_bins) for x in open_bins[room]]


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for all items of a histogram of lengths 1..capacity, and the number of bins.

    A row a run of equal items: length, first rank among the items of that length, first
    bin, items a bin, offset in the bin; sorted by length and rank.
    """
    left = np.zeros(capacity + 1, "i8")
    for length, n in counts.items():
        left[length] = n
    bins = reduce_dominated(left, capacity)
    bins += best_fit(left, capacity)
    used, runs, first = np.zeros(capacity + 1, "i8"), [], 0
    for n, items in bins:
        offset = 0
        for length, each in items:
            runs.append((length, used[length], first, each, offset))
            used[length] += n * each
            offset += length * each
        first += n
    return np.array(sorted(runs), "i8").reshape(-1, 5), first


def token_pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with ``end_id``, cut into pieces of ``capacity``: doc_id, piece, start, length, ids_crc32.

    Null and empty texts are one piece, the end id alone. A null id is kept, repeated rows give their
    pieces again, an empty table gives none. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_path()
    kind = docs.schema[id_col].dataType
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for rows in (part for batch in batches for part in slices(batch, 1)):
            place, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(rows.column(1).to_pylist()):
                ids = own.encode(text) + end
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    place.append(k)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch([rows.column(0).take(pa.array(place, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("body")).mapInArrow(encode, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` of 1..capacity.

    Lengths are whole numbers, so an instance of any number of items is a histogram of at
    most ``capacity`` counts; only that reaches the driver. There, bins that dominate are
    fixed (reduce_dominated), the rest is packed best-fit, and the plan is runs of
    places by length and rank. Items get their ranks in Spark, hashed into buckets that
    grow in number with the rows, so that a length which most rows have is ranked by many tasks. An
    empty table gives an empty result; repeated rows are items of their own. Other columns go through as they
    are, but for ones named sequence_id and offset, which are replaced. A length outside 1..capacity, or null, is an error.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    items = cut(pieces.select(F.struct(*names).alias("row"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("uid")), "pieces")
    counts = {r[0]: int(r[1]) for r in items.groupBy("length").count().collect()}
    if bad := [x for x in counts if x is None or not 0 < x <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    runs, _ = plan(counts, capacity)
    buckets = max(8, min(1 << 16, -(-sum(counts.values()) // BUCKET_ROWS) * 8))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    sizes = items.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "ranks")
    ranked = items.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1)
    # Buckets hold few rows by their number, so no key of this join is hot.
    ranked = ranked.join(broadcast_if_small(sizes, 48), ["length", "bucket"]).select("row", "length", (F.col("own") + F.col("before")).alias("rank"))
    # One sorted key for length and rank; ranks stay below 2^48.
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = runs[np.searchsorted(keys, (length << 48) + rank, "right") - 1].reshape(-1, 5)
            q = rank - run[:, 1]
            yield pa.record_batch([batch.column("row"), pa.array(run[:, 2] + q // np.maximum(run[:, 3], 1)), pa.array(run[:, 4] + q % np.maximum(run[:, 3], 1) * length)], names=["row", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, f"row {items.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return placed.select("row.*", "sequence_id", "offset")
