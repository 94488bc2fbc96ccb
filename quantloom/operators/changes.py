"""Snapshots: hashes, differences, upserts and merges by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scalars import last_by
from quantloom.functions.schemas import drop_labels
from quantloom.functions.tables import cut


def sheet_hash(rows: DataFrame) -> DataFrame:
    """One hash a sheet over its rows' hashes in row order. A sheet is one document of bounded rows, like a spreadsheet; larger
    tables are told apart by blocks of rows as sheets of their own."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row_hash"))), lambda x: F.concat(x["row_no"].cast("string"), F.lit(":"), x["row_hash"]))
    return rows.groupBy("sheet").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sheet_hash"))


#: Rows of a block, and blocks of a group, of a hash tree.
FAN = 1024


def _digest(number: str, digest: str) -> Column:
    """SHA-256 over a group's numbered hashes in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("k"), F.coalesce(F.col(digest), F.lit("")).alias("h")))), lambda x: F.concat(F.coalesce(x["k"].cast("string"), F.lit("")), F.lit(":"), x["h"]))
    return F.sha2(F.array_join(lines, "\n"), 256)


def hash_tree(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """The lowest level of a snapshot's hash tree: (sheet, block, n, block_hash) of each ``fan`` row numbers. A block is equal in two
    snapshots if its hash is, and a fan-th of the rows' number in size."""
    blocks = rows.select("sheet", F.floor(F.col("row_no") / fan).alias("block"), "row_no", "row_hash").groupBy("sheet", "block")
    return blocks.agg(F.count("*").alias("n"), _digest("row_no", "row_hash").alias("block_hash"))


def tree_hash(tree: DataFrame, fan: int = FAN) -> DataFrame:
    """The root of each sheet's tree, over groups of ``fan`` blocks: (sheet, n, sheet_hash)."""
    groups = tree.groupBy("sheet", F.floor(F.col("block") / fan).alias("group")).agg(F.sum("n").alias("n"), _digest("block", "block_hash").alias("group_hash"))
    return groups.groupBy("sheet").agg(F.sum("n").alias("n"), _digest("group", "group_hash").alias("sheet_hash"))


def unequal_blocks(before: DataFrame, after: DataFrame, fan: int = FAN) -> DataFrame:
    """Two trees' blocks that differ or are there once, as a table: (sheet, block, sheet_before, sheet_after), the latter rows of the
    whole sheet. Only sheets with unequal roots have their blocks compared."""
    side = lambda tree, name: tree_hash(tree, fan).select(F.col("sheet").alias(f"sheet_{name}"), F.col("n").alias(f"rows_{name}"), F.col("sheet_hash").alias(f"hash_{name}"))
    sheets = side(before, "a").join(side(after, "b"), F.col("sheet_a").eqNullSafe(F.col("sheet_b")), "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
    sheets = sheets.select(F.coalesce("sheet_a", "sheet_b").alias("_sheet"), F.coalesce("rows_a", F.lit(0)).alias("sheet_before"), F.coalesce("rows_b", F.lit(0)).alias("sheet_after"))
    both = before.withColumn("side", F.lit(0)).unionByName(after.withColumn("side", F.lit(1))).join(sheets, F.col("sheet").eqNullSafe(F.col("_sheet")))
    hashes = both.groupBy("sheet", "block", "sheet_before", "sheet_after").agg(*[F.max(F.when(F.col("side") == k, F.col("block_hash"))).alias(f"h{k}") for k in (0, 1)])
    return cut(hashes.where(~F.col("h0").eqNullSafe(F.col("h1"))).drop("h0", "h1"), "blocks")


def rows_in(rows: DataFrame, blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """Those rows of a snapshot that lie in the blocks; no others leave the scan's stage where the blocks are few."""
    at = blocks.select(F.col("sheet").alias("_sheet"), F.col("block").alias("_block"))
    same = F.col("sheet").eqNullSafe(F.col("_sheet")) & F.floor(F.col("row_no") / fan).eqNullSafe(F.col("_block"))
    return rows.select("sheet", "row_no", "row_hash").join(at, same, "left_semi")


def _change(rows: DataFrame) -> DataFrame:
    change = F.when(F.col("n_before") == 0, "sheet_added").when(F.col("n_after") == 0, "sheet_removed").when(F.col("added_rows") + F.col("modified_rows") > 0, "updated")
    return rows.withColumn("change", change).where("change is not null").drop("n_before", "n_after")


def diff_snapshots(prev: DataFrame, cur: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """Rows (sheet, row_no, row_hash) against those before: a row per sheet with change and counts; sheets
    without edits are left out, as are ones that only shrank.

    With the hash tree that was kept of the snapshot before (``before``; ``after`` is made here if it isn't given), trees are compared from their roots down, and
    rows are joined only under blocks that differ, so that where little has changed little is read of ``prev``, and a sheet of equal hash is no change. Without one,
    making it would shuffle as much as the join of all rows, which is then done."""
    old, new = (rows.select("sheet", "row_no", F.col("row_hash").alias(name)) for rows, name in ((prev, "was"), (cur, "now")))
    blocks = None
    if before is not None:
        blocks = unequal_blocks(before, cut(hash_tree(cur, fan), "tree") if after is None else after, fan)
        old, new = (rows_in(rows, blocks, fan).withColumnRenamed("row_hash", name) for rows, name in ((prev, "was"), (cur, "now")))
    joined = old.withColumn("there", F.lit(1)).join(new.withColumn("here", F.lit(1)), ["sheet", "row_no"], "full")
    counts = joined.groupBy("sheet").agg(
        F.count_if(F.col("there").isNull()).alias("added_rows"), F.count_if(F.col("there").isNotNull() & F.col("here").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))).alias("modified_rows"),
        F.count_if(F.col("here").isNull()).alias("removed_rows"), F.count("there").alias("n_before"), F.count("here").alias("n_after"),
    )
    if blocks is None:
        return _change(counts)
    sizes = blocks.groupBy(F.col("sheet").alias("_sheet")).agg(F.max("sheet_before").alias("n_before"), F.max("sheet_after").alias("n_after"))
    return _change(counts.drop("n_before", "n_after").join(sizes, F.col("sheet").eqNullSafe(F.col("_sheet"))).drop("_sheet"))


def actionable(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change").isin("added", "updated", "sheet_added"))


def upsert(retained: DataFrame, fresh: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The union, where the last row of each key wins and fresh ones come after retained ones."""
    both = retained.withColumn("__batch", F.lit(0)).unionByName(fresh.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    return last_by(both, keys, ["__batch", *order]).drop("__batch")


def merge_predictions(rows: DataFrame, pred: DataFrame) -> DataFrame:
    """Forecasts onto rows by (symbol, row_no); rows that get one are flagged."""
    p = pred.select("symbol", "row_no", F.col("forecast").alias("__f"))
    out = rows.join(p, ["symbol", "row_no"], "left")
    return out.withColumns({"predicted": F.when(F.col("__f").isNotNull(), 1).otherwise(F.coalesce("predicted", F.lit(0))), "forecast": F.coalesce("__f", "forecast")}).drop("__f")


def changed_cells(existing: DataFrame, desired: DataFrame, cols: list[str]) -> DataFrame:
    """Cells (symbol, row_no, column, value) that differ: blanks are alike, numbers within 1e-9, else as text."""
    long = lambda df, v: df.select("symbol", "row_no", F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", v))
    both = long(desired, "value").join(long(existing, "old"), ["symbol", "row_no", "column"], "left")
    a, b = F.trim(F.coalesce("value", F.lit(""))), F.trim(F.coalesce("old", F.lit("")))
    x, y = a.try_cast("double"), b.try_cast("double")
    same = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= 1e-9).otherwise(a == b)
    return both.where(~same).select("symbol", "row_no", "column", a.alias("value"))


def with_context(live: DataFrame, history: DataFrame) -> DataFrame:
    """Live rows after those of history that are strictly older than the symbol's first live date; ``source`` tells which."""
    first = live.groupBy("symbol").agg(F.min("date").alias("__first"))
    old = history.join(first, "symbol").where(F.col("date") < F.col("__first")).drop("__first")
    return old.withColumn("source", F.lit("history")).unionByName(live.withColumn("source", F.lit("live")))


def engineered_with_predictions(df: DataFrame, pred: DataFrame) -> DataFrame:
    """Feature rows with their forecasts for export: labels and internal columns go, doubles have six digits."""
    out = drop_labels(merge_predictions(df, pred))
    kinds = dict(out.dtypes)
    return out.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in out.columns if not c.startswith("__")])
