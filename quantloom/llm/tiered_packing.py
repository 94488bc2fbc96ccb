"""Hierarchical packing of documents into sequences of several lengths, without padding."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import broadcast_if_small, cut, slices, small_batches, whole
from quantloom.llm.tokens import coder, default_path

#: Columns of a plan's runs, a row for parts of equal items: the item's length, where the part starts in it, first rank among items of that length, their
#: number, the part's length, first sequence (one part goes to each), offset there, the sequences' tier, and the first sequence's number in its tier.
RUN = ("item", "start", "rank", "n", "length", "sequence", "offset", "tier", "place")


class _Pool:
    """Items by length: how many there are, and which (number, first item's length, rank and start of the rest)."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {x: n for x, n in counts.items() if n}
        self.lengths = sorted(self.counts)
        self.parts = {x: [(n, x, 0, 0)] for x, n in self.counts.items()}

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        self.counts[length] -= n
        taken, own = [], self.parts[length]
        while n:
            m, item, rank, start = own.pop()
            if m > n:
                own.append((m - n, item, rank + n, start))
                m = n
            taken.append((m, item, rank, start))
            n -= m
        if not self.counts[length]:
            del self.counts[length], self.parts[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        return taken

    def put(self, length: int, part: tuple[int, int, int, int]) -> None:
        if length not in self.counts:
            self.counts[length], self.parts[length] = 0, []
            insort(self.lengths, length)
        self.counts[length] += part[0]
        self.parts[length].append(part)

    def fitting(self, room: int, used: Counter, n: int) -> int | None:
        """The longest item of at most ``room`` that ``n`` sequences can have beside those used."""
        return next((x for k in range(bisect_right(self.lengths, room) - 1, -1, -1) if self.counts[x := self.lengths[k]] >= n * (used[x] + 1)), None)

    def longer(self, room: int, used: Counter, n: int) -> int | None:
        """The shortest item longer than ``room`` that ``n`` sequences can have beside those used."""
        return next((x for k in range(bisect_right(self.lengths, room), len(self.lengths)) if self.counts[x := self.lengths[k]] >= n * (used[x] + 1)), None)


def plan(counts: dict[int, int], capacity: int = 2048, base: int = 256, least_part: int = 32) -> tuple[np.ndarray, dict[int, int]]:
    """Places for all items of a histogram of lengths 1..capacity: runs (see RUN), and the number of sequences of each tier.

    Tiers are the powers of two from ``base`` to ``capacity``; an item belongs to the smallest that holds it. From the longest
    item down, a sequence of the item's tier is begun with it and its gap filled by the longest items that fit, exactly if one does; these come from
    the same tier only where it is the shortest, else from shorter ones. Where none fits the gap, the shortest longer item, of those that keep ``least_part``
    if there are any, is cut at the gap, and its rest goes back among the items, in the tier of its new length. What is left at last makes sequences of lower
    powers of two, so that no sequence has padding. Sequences of equal contents are made in one step, of at least a 256th of the items of the longest length
    where that can be, so the work follows the number of lengths and the logarithm of the number of items.
    """
    if capacity & (capacity - 1) or base & (base - 1) or not 0 < base <= capacity:
        raise ValueError("tiers are powers of two")
    pool, left, first, tiers, runs = _Pool(counts), sum(x * n for x, n in counts.items()), 0, Counter(), []
    while left:
        longest = pool.lengths[-1]
        tier = max(base, 1 << (longest - 1).bit_length())
        if tier > left:
            tier = 1 << (left.bit_length() - 1)
        slots, gap = [(longest, min(longest, tier))], tier - min(longest, tier)
        used, most = Counter({longest: 1}), max(1, min(pool.counts[longest] >> 8, left // tier))
        while gap:
            x = pool.fitting(gap, used, most)
            if x is None and (x := pool.longer(gap + least_part, used, most) or pool.longer(gap, used, most)) is None:
                most = 1
                continue
            k = min(gap // x, pool.counts[x] // most - used[x]) or 1
            slots += [(x, min(x, gap))] * k
            used[x] += k
            gap -= slots[-1][1] * k
        n = min(min(pool.counts[x] // k for x, k in used.items()), left // tier)
        offset, rests = 0, []
        for x, length in slots:
            q = 0
            for m, item, rank, start in pool.take(x, n):
                runs.append((item, start, rank, m, length, first + q, offset, tier, tiers[tier] + q))
                if length < x:
                    rests.append((x - length, (m, item, rank, start + length)))
                q += m
            offset += length
        for rest in rests:
            pool.put(*rest)
        first += n
        tiers[tier] += n
        left -= n * tier
    return np.array(sorted(runs), "i8").reshape(-1, len(RUN)), dict(tiers)


def steps(tier: np.ndarray, place: np.ndarray, tiers: dict[int, int], step_tokens: int) -> np.ndarray:
    """The training step of each sequence, from its tier and its number there.

    A step has sequences of one tier, step_tokens / tier of them, so steps cost alike. A tier's sequences are dealt to its steps in turn, as neighbours
    are made alike by the plan, and the steps of all tiers are mixed evenly: the i-th of m stands at (i + 1/2) / m of the way, ties by length.
    """
    groups = {t: max(1, -(-n * t // max(step_tokens, t))) for t, n in tiers.items()}
    out = np.zeros(len(tier), "i8")
    for t, m in groups.items():
        own = tier == t
        i = place[own] % m
        before = i.copy()
        for u, k in groups.items():
            if u != t:
                # Steps j of u with (2j + 1) * m below (2i + 1) * k, or equal to it where u is shorter.
                before += np.clip(((2 * i + 1) * k - m + (-1 if u > t else 0)) // (2 * m) + 1, 0, k)
        out[own] = before
    return out


def token_items(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with ``end_id`` as items of ``capacity`` and one of the rest: doc_id, start, length, doc_tokens, ids_crc32, ids (of
    the rest only, the others aren't cut; little-endian), and its place among the items of its task and length: task, nth. Null and empty texts are the
    end id alone, null ids stay, repeated rows give their items again. Other columns are ignored."""
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, task = coder(vocabulary), Counter(), TaskContext.get().partitionId()
        for rows in (part for batch in batches for part in slices(batch, 1)):
            row, start, length, total, crc, ids, nth = [], [], [], [], [], [], []
            for k, text in enumerate(rows.column(1).to_pylist()):
                all_ids = own.encode(text) + end
                for at in range(0, len(all_ids), step):
                    part = all_ids[at : at + step]
                    n = len(part) // 4
                    row.append(k)
                    start.append(at // 4)
                    length.append(n)
                    total.append(len(all_ids) // 4)
                    crc.append(zlib.crc32(part))
                    ids.append(part if n < capacity else None)
                    nth.append(seen[n])
                    seen[n] += 1
            columns = [rows.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc)), pa.array(ids, pa.binary()), pa.array([task] * len(row), pa.int64()), pa.array(nth, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "task", "nth"])

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids_crc32 long, ids binary, task long, nth long"
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("body")).mapInArrow(encode, schema)


def _parts(length: np.ndarray, rank: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items by length and rank: which item, which run and which place in it, a row a part."""
    # One sorted key for (length, start) and rank; ranks stay below 2^40.
    pairs, at = np.unique(runs[:, 0] << 20 | runs[:, 1], return_inverse=True)
    keys = (at << 40) + runs[:, 2]
    todo, start, found = np.arange(len(length)), np.zeros(len(length), "i8"), []
    while len(todo):
        pair = np.searchsorted(pairs, length[todo] << 20 | start[todo])
        run = np.searchsorted(keys, (pair << 40) + rank[todo], "right") - 1
        found.append((todo, run, rank[todo] - runs[run, 2]))
        start[todo] += runs[run, 4]
        todo = todo[start[todo] < length[todo]]
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, "i8")]) for k in range(3))


def pack_tiers(items: DataFrame, capacity: int = 2048, base: int = 256, step_tokens: int = 1 << 16) -> DataFrame:
    """Pieces of all items of token_items(): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (its sequence's length) and step.

    Only a histogram of ``capacity`` counts reaches the driver, where plan() turns it into runs of places by length and rank. Items were counted by
    the tasks that wrote them, so an item's rank is its place there moved up by the tasks before, and nothing is sorted; a cut item's ids are cut
    as the plan has it. An empty table gives an empty result."""
    items = cut(items, "items")
    sizes = cut(items.groupBy("length", "task").agg(F.count("*").alias("n")), "sizes")
    counts = {r["length"]: int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, tiers = plan(counts, capacity, base)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut(sizes.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), "ranks")
    # A task's items of one length are bounded by its input, so no key of this join is hot.
    ranked = items.join(broadcast_if_small(sizes, 48), ["length", "task"]).select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", (F.col("nth") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, rank = (batch.column(c).to_numpy() for c in ("start", "length", "rank"))
            item, run, q = _parts(length, rank, runs)
            at, own = runs[run, 1], runs[run, 4]
            crc = batch.column("ids_crc32").to_numpy()[item]
            ids = batch.column("ids")
            for k in np.flatnonzero(own < length[item]).tolist():
                crc[k] = zlib.crc32(ids[int(item[k])].as_py()[4 * at[k] : 4 * (at[k] + own[k])])
            rows = pa.array(item)
            columns = [batch.column("doc_id").take(rows), *(pa.array(x) for x in (start[item] + at, own, crc)), batch.column("doc_tokens").take(rows)]
            columns += [pa.array(x) for x in (runs[run, 5] + q, runs[run, 6], runs[run, 7], steps(runs[run, 7], runs[run, 8] + q, tiers, step_tokens))]
            yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"])

    kind = items.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step long")
