"""Benchmark decontamination, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shared import broadcast_if_small, cut, fits, whole

#: All that stands between words, after lower().
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(c: str) -> Column:
    return F.array_remove(F.split(F.lower(whole(c)), GAPS), "")


def _shingles(words: str, n: int, of) -> Column:
    """``of`` n consecutive words at each place, distinct; a shorter, non-empty text has one
    shingle, all its words. The lambda sees only zipped words, never the whole array."""
    padded = F.concat(F.col(words), F.array_repeat(F.lit(""), n - F.size(words)))
    places = F.greatest(F.size(words) - n, F.lit(0)) + 1
    zipped = F.arrays_zip(*[F.slice(padded, k + 1, places).alias(f"w{k}") for k in range(n)])
    return F.array_distinct(F.transform(zipped, lambda x: of(*[x[f"w{k}"] for k in range(n)])))


def _text(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def passed(probes: DataFrame, sketch: DataFrame) -> DataFrame:
    """The rows whose hash ``h`` may be in the sketches, by a bitmap of 2^24 bits: a broadcast of at most 2^18 words of 64 bits."""
    slot = F.shiftrightunsigned("h", 40)
    word, bit = F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("bit")
    bitmap = cut(sketch.select(word, bit).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "sketch-bitmap")
    hits = probes.withColumns({"word": word, "bit": bit}).join(F.broadcast(bitmap), "word")
    return hits.where(F.getbit("bits", "bit") == 1).select(*probes.columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a test item of whose word shingles it has ``percent`` or more.

    Containment search with size-partitioned MinHash: items fall into classes by the
    binary logarithm of their number s of shingles. A fixed-length MinHash signature of a
    document can't show a short item inside a long text (their Jaccard similarity is near
    0), so the sketch of an item is its bottom-k MinHash, the k shingles of smallest
    hash. For s shingles of which m must be found, k is s - m + 1, so that at least one of the k is in any
    document that contains the item: no such document is missed, whatever its length. Each
    class has bounds of its own: the least number of shingles that a document must have, and the
    greatest hash in its sketches. A document probes the classes that it can hold, with
    those of its shingles whose hash is within the greatest of their bounds; all others are
    dropped where they are made, before anything is joined.

    Documents meet the sketches in a broadcast join while the sketches' measured size is
    bounded. Else shingles first pass a bitmap of the sketches' hashes (of fixed size), and what is left,
    each shingle once a document, goes to a shuffled join with split hot keys. Candidates are then
    verified on the shingles themselves, as strings.

    Returns doc_id, item_id, shared, item_shingles (long), containment (double); one row
    a pair. Words are runs of letters and digits (any character beyond ASCII counts as one),
    in lower case. A text of fewer than ``n`` words is one shingle, and so matches only a
    text of the same words. Null and empty texts match nothing. Repeated rows of an id
    count once, together; rows with a null id match nothing.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    items = benchmark.select(F.col(item_col).alias("item_id"), _words(item_text_col).alias("w")).where("item_id is not null and size(w) > 0")
    items = items.select("item_id", _shingles("w", n, _text).alias("grams"), _shingles("w", n, F.xxhash64).alias("hashes"))
    need = F.ceil(F.size("grams") * F.lit(percent) / 100).cast("int")
    items = items.withColumns({"need": need, "class": F.floor(F.log2(F.size("grams"))).cast("int")})
    items = cut(items, "items")
    sketch = items.select("class", "item_id", "need", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), F.size("hashes") - F.col("need") + 1)).alias("h"))
    sketch = cut(sketch, "sketches")
    # At most a row for each power of two.
    bounds = sketch.groupBy("class").agg(F.min("need").alias("least"), F.max("h").alias("bound")).orderBy("class").collect()

    # Neither a filter on the words nor an inner explode, whose implied filter would be pushed down: both would cut the
    # texts twice. A text without words has m = 0, which no class can be held by.
    sized = docs.select(F.col(id_col).alias("doc_id"), _words(text_col).alias("w")).where("doc_id is not null")
    sized = sized.select("doc_id", F.size("w").alias("words"), _shingles("w", n, F.xxhash64).alias("hashes"))
    sized = sized.select("doc_id", F.when(F.col("words") > 0, F.size("hashes")).otherwise(0).alias("m"), "hashes")
    bound = F.greatest(F.lit(-(1 << 63)), *[F.when(F.col("m") >= r["least"], F.lit(r["bound"])) for r in bounds], F.lit(-(1 << 63)))
    probes = sized.select("doc_id", "m", bound.alias("bound"), F.explode_outer("hashes").alias("h")).where("h <= bound").drop("bound")
    own = F.broadcast(sketch) if fits(sketch.count() * 64) else None
    found = (probes if own is not None else passed(probes, sketch)).join(sketch if own is None else own, "h").where(F.col("m") >= F.col("need"))
    found = cut(found.select("doc_id", "item_id").distinct(), "candidates")

    ids = cut(found.select("doc_id").distinct(), "candidate-docs")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).join(broadcast_if_small(ids, 64), "doc_id", "left_semi")
    grams = texts.select("doc_id", _words("body").alias("w")).select("doc_id", _shingles("w", n, _text).alias("doc_grams"))
    full = items.select("item_id", "grams", "need")
    size = items.agg(F.sum(F.size("grams") * 16 + F.octet_length(F.array_join("grams", "")))).first()[0] or 0
    pairs = grams.join(broadcast_if_small(found, 64), "doc_id").join(F.broadcast(full) if fits(size) else full, "item_id")
    pairs = pairs.select("doc_id", "item_id", "need", F.size("grams").alias("size"), F.size(F.array_intersect("grams", "doc_grams")).alias("shared"))
    pairs = pairs.where("shared >= need").groupBy("doc_id", "item_id").agg(F.max("shared").cast("long").alias("shared"), F.max("size").cast("long").alias("item_shingles"))
    return pairs.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with the input's columns, whatever their names. Rows with a null id
    or an empty text stay; all rows of an id stay or go together; without items all stay."""
    bad = broadcast_if_small(cut(contaminated(docs, benchmark, id_col=id_col, **how).select("doc_id").distinct(), "contaminated"), 64)
    return docs.join(bad, docs[id_col] == bad["doc_id"], "left_anti")
