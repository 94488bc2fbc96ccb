"""Line deduplication over the corpus, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shared import BLANK, ascii_lower, broadcast_if_small, cut, fits, repeated, whole


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(BLANK)))


def _hashed(key: Column) -> list[Column]:
    """128 bits of a key, as 64 leave a few collisions among 10^12 lines."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents.

    1. Lines are normalised, made distinct within their document, exploded and hashed;
       documents are counted per hash, pre-aggregated before the shuffle, so a line that
       all documents share costs a row a partition. Only ids that stand on several rows, which a
       look at the ids alone finds, have their lines made distinct by id first.
    2. Lines are exploded with their positions and joined with the frequent hashes: a
       broadcast while their measured size is bounded, else a shuffled join that Spark
       splits at hot keys. Only positions to drop go on.
    3. Documents get their dropped positions and are put together by position from the
       others; the texts move only if the positions are too large to broadcast.

    Returns a row per row: doc_id, n_lines, n_dropped (long), kept_text.

    Null text counts as empty, and an empty text is one empty line. Keys under
    ``min_chars`` code points always stay. Rows of one id count as one document; each
    row with a null id counts as one of its own. A document that loses all its lines has the empty text. An empty table gives
    an empty result; other columns are ignored.
    """
    # The hash is a column of its own, as beside a generator it would be computed again for each line.
    base = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("body")).withColumn("body_hash", F.xxhash64("body"))
    lines = F.split("body", "\n", -1)
    def keys(rows: DataFrame) -> DataFrame:
        own = rows.select("doc_id", F.explode_outer(F.array_distinct(F.transform(lines, line_key))).alias("key")).where(F.char_length("key") >= min_chars)
        return own.select("doc_id", *_hashed(F.col("key")))

    twice, once = repeated(base, "doc_id"), keys(base)
    if not twice.isEmpty():
        some = broadcast_if_small(twice, 64)
        once = keys(base.join(some, "doc_id", "left_anti")).union(keys(base.join(some, "doc_id", "left_semi")).distinct())
    frequent = once.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n")
    frequent = cut(frequent, "frequent-lines")

    placed = base.select("doc_id", "body_hash", F.posexplode_outer(F.transform(lines, line_key)).alias("pos", "key"))
    placed = placed.where(F.char_length("key") >= min_chars).select("doc_id", "body_hash", "pos", *_hashed(F.col("key")))
    hits = placed.join(broadcast_if_small(frequent, 64), ["h1", "h2"])
    hits = cut(hits.groupBy("doc_id", "body_hash").agg(F.collect_set("pos").alias("dropped")), "dropped-lines")
    size = hits.agg(F.sum(F.size("dropped") * 8 + 64)).first()[0] or 0

    split = base.select(F.col("doc_id").alias("id"), F.col("body_hash").alias("hash"), lines.alias("lines"))
    joined = split.join(F.broadcast(hits) if fits(size) else hits, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("body_hash")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("dropped", F.array().cast("array<int>")))
    return joined.select(
        F.col("id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), "lines", kept.alias("places")
    ).select("doc_id", "n_lines", "n_dropped", F.array_join(F.transform("places", lambda p: F.get("lines", p)), "\n").alias("kept_text"))
