"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shared import broadcast_if_small, cut, whole


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 48, growth: int = 8, carry: bool = False) -> DataFrame:
    """Group rows whose texts are equal once each run of ASCII white space is one space.

    The texts are split by successive bytes, most significant first: the leading digit is
    the byte length with the first ``first`` bytes, and each level takes the next digit,
    ``growth`` times as wide as the one before. A group that has one row left, or whose
    bytes are used up, leaves; the others go on with the rest of their bytes. So equality
    rests on the bytes alone, no digest decides, the number of levels is logarithmic in
    the longest text that has a possible copy, and only such texts move. A group is never gathered in one
    task: counts and smallest ids are pre-aggregated in each input partition, and rows get
    them back through a broadcast of measured size or a join whose hot keys Spark splits.

    Returns a row per row: doc_id, keep_id, group_size, kept, text_sha256, and with
    ``carry`` a struct ``row`` of all the input's columns.

    Null text counts as empty; all empty texts are one group. A null id sorts last. Of
    repeated rows with one id, one is kept. An empty table gives an empty result. Other
    columns of the input are untouched, whatever their names.
    """
    spark = docs.sparkSession
    body = F.regexp_replace(whole(text_col), "[\\x20\\x09-\\x0D]+", " ")
    base = docs.select(F.col(id_col).alias("doc_id"), body.cast("binary").alias("body"), *([F.struct("*").alias("row")] if carry else []))
    base = base.withColumns({"size": F.octet_length("body"), "digit": F.substring("body", 1, first)})
    kept_cols = ["doc_id", *(["row"] if carry else [])]

    shared = base.groupBy("size", "digit").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(shared.select("size", "digit", F.monotonically_increasing_id().alias("gid")), "radix-0")
    active = F.col("gid").isNotNull()
    rows = base.join(broadcast_if_small(shared, first + 64), ["size", "digit"], "left").select(
        *kept_cols, "gid", "size", F.sha2("body", 256).alias("sha"),
        F.when(active, F.substring(F.col("body"), F.lit(first + 1), F.col("size"))).alias("rest"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = cut(rows, "radix-rows")

    def out(df: DataFrame, keep_id, n, kept) -> DataFrame:
        return df.select("doc_id", keep_id.alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), *kept_cols[1:])

    done = [out(rows.where(~active), F.col("doc_id"), F.lit(1), F.lit(True))]
    rows = rows.where(active)
    width, used = first * growth, first
    longest = rows.agg(F.max("size")).first()[0]
    while longest is not None:
        used += width
        level = rows.withColumn("digit", F.substring("rest", 1, width))
        groups = level.groupBy("gid", "digit").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "uid")).alias("first"))
        groups = cut(groups.where("n > 1").select("gid", "digit", "n", "first", F.monotonically_increasing_id().alias("next")), "radix-groups")
        joined = level.join(broadcast_if_small(groups, width + 96), ["gid", "digit"], "left")
        joined = joined.withColumn("over", F.col("n").isNull() | (F.col("size") <= used))
        joined = cut(joined.select(*kept_cols, F.col("next").alias("gid"), "size", "sha", "uid", "n", "first", "over", F.when(~F.col("over"), F.substring(F.col("rest"), F.lit(width + 1), F.col("size"))).alias("rest")), "radix-rows")
        over = joined.where("over")
        lone = F.col("n").isNull()
        done.append(out(over, F.when(lone, F.col("doc_id")).otherwise(F.col("first.doc_id")), F.coalesce("n", F.lit(1)), lone | (F.col("uid") == F.col("first.uid"))))
        if longest <= used:
            break
        rows = joined.where("not over").drop("n", "first", "over")
        longest = rows.agg(F.max("size")).first()[0]
        width *= growth
    return reduce(DataFrame.union, done)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup() keeps, with the input's columns, whatever their names. Null, empty and
    blank texts are at most two groups (empty, one space); a row without an id stays only if its group has none with one."""
    return exact_dedup(docs, id_col, text_col, carry=True).where("kept").select("row.*")
