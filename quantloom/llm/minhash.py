"""MinHash near-duplicate detection by an inverted join of signature coordinates."""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.components import components
from quantloom.llm.shared import broadcast_if_small, cut, join_hot, repeated, slices, small_batches, whole
from quantloom.llm.shingles import shingle_sets

#: Signature coordinates, and the chance at most that a pair just at the threshold has too few matches.
COORDINATES, MISS = 32, 1e-6
#: A coordinate value that more classes have is posted only where a document has nothing rarer.
HOT = 64
#: Documents of a family of near copies, and shingles in them, that a task compares with as many others.
BLOCK, BLOCK_SHINGLES = 200, 1 << 21
#: Shingles that are hashed at a time, and that a task keeps of sets that come again.
ROWS, CACHED = 8192, 1 << 20
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64, 256, dtype="u8")


def least_matches(percent: int, k: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of matches that a pair of similarity ``percent`` falls short of with a chance of at most ``miss``."""
    p, tail = percent / 100, 0.0
    for t in range(k + 1):
        tail += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > miss:
            return max(1, t)
    return k


def signature(hashes: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    out = np.full(k, 2**64 - 1, "u8")
    for at in range(0, len(hashes), ROWS):
        out = np.minimum(out, (hashes[at : at + ROWS, None] * _A[:k] + _B[:k]).min(0))
    return (out >> np.uint64(32)).astype("u4").view("i4")


def signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, body_hash, n_shingles, set_hash (128 bits of the sorted set, null if empty), sig."""
    kinds = {"n_shingles": pa.int64(), "set_hash": pa.binary(), "sig": pa.list_(pa.int32())}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                size, digest, sig = [], [], []
                for s in shingle_sets(part.column("body").cast(pa.binary()).to_pylist(), n):
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(signature(s) if len(s) else None)
                yield pa.record_batch([part.column("doc_id"), part.column("body_hash"), *(pa.array(x, t) for x, t in zip((size, digest, sig), kinds.values(), strict=True))], names=["doc_id", "body_hash", *kinds])

    return docs.mapInArrow(sign, "doc_id long, body_hash long, n_shingles long, set_hash binary, sig array<int>")


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, body: the text of each class's row, by its id and the hash of its text."""
    own = docs.withColumnRenamed("doc_id", "rep").join(broadcast_if_small(reps, 64), ["rep", "body_hash"], "left_semi")
    return cut(own.select("rep", "body").dropDuplicates(["rep"]), "class-texts")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have that Jaccard similarity, counted in whole numbers."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "pair-ids")
    texts = texts_of(docs, cut(classes.select("rep", "body_hash").join(broadcast_if_small(ids, 48), "rep", "left_semi"), "pair-docs"))
    one, two = texts.select(F.col("rep").alias("a"), F.col("body").alias("x")), texts.select(F.col("rep").alias("b"), F.col("body").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()  # sets of a, up to CACHED shingles

        def left(a: int, text: pa.StringScalar) -> np.ndarray:
            if a not in kept:
                kept[a] = next(shingle_sets([text.as_py().encode()], n))
                while sum(map(len, kept.values())) > CACHED and len(kept) > 1:
                    kept.popitem(last=False)
            return kept[a]

        for batch in batches:
            for part in slices(batch, "y"):
                good = []
                right = shingle_sets(part.column("y").cast(pa.binary()).to_pylist(), n)
                for a, text, t in zip(part.column("a").to_pylist(), part.column("x"), right, strict=True):
                    both = np.concatenate([left(a, text), t])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    good.append(100 * shared >= percent * (len(both) - shared) and len(both) > 0)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Joined by a last, so that pairs with the same a come together.
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets, by products of parts of its incidence matrix."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times > 1
    column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), "f4")
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        part = np.zeros((len(sets), 4096), "f4")
        part[row[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def family_links(lists: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) across components within long lists (token, rep, body_hash, size, component), one for each two components and block at least.

    Long lists that share classes make a family. Its classes are dealt into blocks of
    bounded rows and shingles, those of a large component into blocks of their own, and each two
    blocks that may hold different components meet once in a task, which compares the full
    sets. So pairs are neither emitted nor left out, and pairs within a large component
    are never compared. The work is the square of a family's blocks, spread over as many
    tasks; no task grows with a family.
    """
    hubs = cut(lists.groupBy("token").agg(F.min("rep").alias("hub")), "long-tokens")
    rows = cut(join_hot(lists, hubs, ["token"], 48).select("hub", "rep", "body_hash", "size", "component").distinct(), "long-lists")
    if rows.isEmpty():
        return rows.select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    family = components(rows.select(F.col("hub").alias("a"), F.col("rep").alias("b"))).select(F.col("id").alias("rep"), F.col("component").alias("family"))
    members = cut(rows.drop("hub").distinct().join(family, "rep"), "families")
    large = members.groupBy("family", "component").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK).select("family", "component", F.struct(F.lit(1).alias("own"), F.col("component").alias("id")).alias("part"))
    members = join_hot(members, cut(large, "large-components"), ["family", "component"], 64, "left")
    members = cut(members.withColumn("part", F.coalesce("part", F.struct(F.lit(0).alias("own"), F.lit(0).cast("long").alias("id")))), "part-members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    sizes = cut(members.groupBy("family", "part").agg(blocks.alias("blocks")), "blocks")
    members = join_hot(members, sizes, ["family", "part"], 64).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = cut(members.select("rep", "body_hash", "component", "family", "part", "block"), "members")
    # Each block with all blocks from itself on, generated by rows of blocks, not by a join of a family with itself.
    cells = sizes.select("family", F.col("part").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q")).repartition("family", "p", "q")
    meet = join_hot(cut(cells, "cells"), cut(sizes.groupBy("family").agg(F.collect_list(F.struct("part", "blocks")).alias("parts")), "family-parts"), ["family"], 4096)
    meet = meet.select("family", "p", "q", F.explode("parts").alias("o")).where("p < o.part or (p = o.part and p.own = 0)")
    meet = meet.select("family", "p", "q", F.col("o.part").alias("r"), F.explode(F.sequence(F.when(F.col("p") == F.col("o.part"), F.col("q")).otherwise(0), F.col("o.blocks") - 1)).alias("s"))
    meet = cut(meet, "block-pairs")
    texts = texts_of(docs, members.select("rep", "body_hash"))
    meeting = F.xxhash64("family", "p", "q", "r", "s").alias("meeting")
    sides = members.withColumnsRenamed({"part": "p", "block": "q"}).join(meet, ["family", "p", "q"]).select("rep", "component", meeting)
    other = meet.where("p <> r or q <> s")
    sides = sides.union(members.withColumnsRenamed({"part": "r", "block": "s"}).join(other, ["family", "r", "s"]).select("rep", "component", meeting))
    met = sides.join(texts, "rep").select("meeting", "rep", "component", "body")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        ids, own = rows["rep"].to_numpy(), rows["component"].to_numpy()
        shared = overlaps(list(shingle_sets([t.encode() for t in rows["body"]], n)))
        size = np.diag(shared)
        good = (100 * shared >= percent * (size[:, None] + size - shared)) & (own[:, None] != own)
        a, b = np.nonzero(np.triu(good))
        out = pd.DataFrame({"a": ids[a], "b": ids[b], "x": own[a], "y": own[b]})
        return out.drop_duplicates(["x", "y"])[["a", "b"]]

    return met.groupBy("meeting").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """Link documents whose sets of ``n``-word shingles have a Jaccard similarity of ``percent`` or more.

    Words are runs without ASCII white space, A-Z in lower case.

    1. Documents with equal sets are one class; its smallest id stands for it. A class of
       any size takes part as one row.
    2. Each class has COORDINATES minima. Two of ``percent`` similarity match in T of them
       at least (but for a chance of ``miss`` a pair at the threshold, which any smaller value makes as small
       as wanted, at the price of longer lists), so, with all coordinate values in one order, they share
       one of their first COORDINATES - T + 1. Classes are posted under these only. Values
       that more than HOT classes have come last in the order, by frequency; such long
       lists are skipped wherever a document has enough rarer values.
    3. In each posting list every class meets the list's smallest, and collisions are counted by
       pair as the lists are merged; only the coordinates whose lists were skipped or led by another class are then
       probed in the signatures. Pairs with T collisions are confirmed on the full sets and joined into components.
    4. Lists with classes of several components are compared across components; pairs
       within one need no test, as a link there changes nothing. Lists of up to HOT classes are
       joined with themselves; longer ones go block by block (family_links). So a list of near copies costs a
       pair a member, and no candidate is left out.

    Returns a row per row: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Ids are cast to long. Null, empty and blank texts have no shingles and link with nothing. Rows with a null
    id are kept, alone, with a null component. Rows of one id are one document: of several
    sets the one of least hash counts, and all its rows get that component. An empty table gives an empty
    result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("body")).withColumn("body_hash", F.xxhash64("body"))
    rows = cut(signed(base, n), "signed")
    need = least_matches(percent, miss=miss)
    prefix = COORDINATES - need + 1
    known = rows.where("doc_id is not null and set_hash is not null")
    twice = repeated(rows, "doc_id")
    if not twice.isEmpty():
        several = known.join(broadcast_if_small(twice, 48), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("set_hash", "n_shingles", "sig", "body_hash")).alias("m"))
        known = known.join(broadcast_if_small(twice, 48), "doc_id", "left_anti").unionByName(several.select("doc_id", "m.*"))
    classes = known.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "body_hash")).alias("m"))
    classes = cut(classes.select("set_hash", F.col("m.doc_id").alias("rep"), F.col("m.body_hash").alias("body_hash"), F.col("m.n_shingles").alias("size"), F.col("m.sig").alias("sig")), "classes")

    # Coordinate and value in one long; values as unsigned.
    tokens = classes.select("rep", F.posexplode("sig").alias("pos", "v")).withColumn("token", F.shiftleft(F.col("pos").cast("long"), 32) + F.col("v").cast("long"))
    hot = cut(tokens.groupBy("token").agg(F.count("*").alias("times")).where(F.col("times") > HOT), "hot-tokens")
    late = join_hot(tokens, hot, ["token"], 32).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("times", "pos"))).alias("late"))
    late = late.select(F.col("rep").alias("id"), F.transform("late", lambda x: x["pos"]).alias("late"))
    ordered = classes.join(late, classes["rep"] == late["id"], "left").withColumn("late", F.coalesce("late", F.array().cast("array<int>")))
    order = F.concat(F.array_except(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), "late"), "late")
    firsts = F.transform(F.slice(order, 1, prefix), lambda p: F.struct((F.shiftleft(p.cast("long"), 32) + F.get("sig", p).cast("long")).alias("token"), p.alias("pos"), F.array_contains("late", p).alias("hot")))
    posted = cut(ordered.select("rep", "body_hash", "size", F.explode(firsts).alias("t")).select("rep", "body_hash", "size", "t.*"), "postings")

    def with_lists(posted: DataFrame, lists: DataFrame) -> DataFrame:
        """Postings with a value of their list; of long lists, which are few, no task gets one whole."""
        long = cut(lists.where("hot").drop("hot"), "long-lists")
        return posted.where("not hot").join(lists.where("not hot").drop("hot"), "token").unionByName(join_hot(posted.where("hot"), long, ["token"], 48))

    lists = posted.groupBy("token", "hot").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1")
    posted = cut(with_lists(posted, cut(lists, "lists")), "shared-postings")

    one = classes.select(F.col("rep").alias("a"), F.col("size").alias("size_a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("size").alias("size_b"), F.col("sig").alias("sig_b"))

    def likely(hits: DataFrame) -> DataFrame:
        """Pairs with ``need`` collisions at least, from rows (a, b, pos), one a collision met in a list."""
        pairs = hits.groupBy("a", "b").agg(F.count("*").cast("int").alias("met"), F.bit_or(F.expr("shiftleft(1L, pos)")).alias("seen"))
        same = F.zip_with("sig_a", "sig_b", lambda x, y: x == y)
        probed = F.size(F.filter(same, lambda x, p: x & (F.getbit("seen", p) == 0)))
        fits = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
        return pairs.join(one, "a").join(two, "b").where(fits & (F.col("met") + probed >= need)).select("a", "b")

    stars = posted.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"), "pos")
    links = cut(confirmed(cut(likely(stars), "pairs"), base, classes, n, percent), "star-links")
    found = cut(components(links), "star-components")

    labelled = cut(posted.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled-postings")
    mixed = labelled.groupBy("token", "hot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "hot")
    labelled = cut(with_lists(labelled, cut(mixed, "mixed-lists")), "mixed-postings")
    short = labelled.where((F.col("n") <= HOT) & (F.col("rep") != F.col("first")))
    x = short.select("token", "pos", F.col("rep").alias("a"), F.col("component").alias("p"))
    y = short.select("token", F.col("rep").alias("b"), F.col("component").alias("q"))
    across = x.join(y, "token").where("a < b and p <> q").select("a", "b", "pos")
    more = confirmed(cut(likely(across), "pairs"), base, classes, n, percent)
    more = cut(more.union(family_links(labelled.where(F.col("n") > HOT), base, n, percent)), "cross-links")
    if not more.isEmpty():
        found = components(links.union(more))

    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = rows.join(named, "set_hash", "left")
    if not twice.isEmpty():
        own = cut(several.select("doc_id", F.col("m.set_hash").alias("set_hash")).join(named, "set_hash").select("doc_id", F.col("component").alias("own")), "repeated-ids")
        out = out.join(broadcast_if_small(own, 48), "doc_id", "left").withColumn("component", F.coalesce("own", "component"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with the input's columns, whatever their names. Rows
    with a null id or without words stay, all rows of an id stay or go together, and an empty table gives an empty one."""
    gone = near_duplicates(docs, n, percent, id_col, text_col).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept")
    gone = broadcast_if_small(cut(gone.select("doc_id"), "near-copies"), 64)
    return docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")
