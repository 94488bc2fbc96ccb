"""Repair, selection and reports over raw bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quantloom.functions.scalars import parse_date, to_number
from quantloom.functions.schemas import FeatureError


def typed(raw: DataFrame) -> DataFrame:
    """Text columns symbol, date, open, high, low, close, volume to values; what can't be read is null."""
    return raw.withColumns({"date": parse_date(F.col("date"))} | {c: to_number(F.col(c)) for c in ("open", "high", "low", "close", "volume")})


def flag_malformed(bars: DataFrame) -> DataFrame:
    """The first reason for which a bar is bad, else null."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    missing = F.exists(F.array(*prices), lambda x: x.isNull())
    reason = F.when(F.col("date").isNull(), "date").when(missing, "price").when(F.col("high") < F.col("low"), "range").when(F.col("close") <= 0, "close")
    return bars.withColumn("reason", reason)


def valid_ohlcv(bars: DataFrame, check: bool = False) -> DataFrame:
    """The bars without a reason against them; with ``check`` an error if none remain."""
    good = flag_malformed(bars).where("reason is null").drop("reason")
    if check and good.isEmpty():
        raise FeatureError("no valid dated OHLCV rows remain")
    return good


def repaired_cells(raw: DataFrame) -> DataFrame:
    """Adds the number of a text row's cells whose text isn't the one that its value is written with: the day as
    yyyy-MM-dd, prices as doubles, the volume as a whole number, thousands separators aside."""
    text = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""))
    own = [F.trim("date") != parse_date(F.col("date")).cast("string")]
    own += [text(F.col(c)) != to_number(F.col(c)).cast("string") for c in ("open", "high", "low", "close")]
    own += [text(F.col("volume")) != to_number(F.col("volume")).cast("long").cast("string")]
    return raw.withColumn("repaired", sum((F.coalesce(x, F.lit(False)).cast("int") for x in own), F.lit(0)))


def typed_cells(raw: DataFrame) -> DataFrame:
    """typed() and repaired_cells() at once: each cell is parsed once."""
    values = {"date": parse_date(F.col("date"))} | {c: to_number(F.col(c)) for c in ("open", "high", "low", "close", "volume")}
    df = raw.withColumns({f"__{c}": v for c, v in values.items()})
    text = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""))
    own = [F.trim("date") != F.col("__date").cast("string"), text("volume") != F.col("__volume").cast("long").cast("string")]
    own += [text(c) != F.col(f"__{c}").cast("string") for c in ("open", "high", "low", "close")]
    repaired = sum((F.coalesce(x, F.lit(False)).cast("int") for x in own), F.lit(0))
    return df.withColumn("repaired", repaired).withColumns({c: F.col(f"__{c}") for c in values}).drop(*[f"__{c}" for c in values])


def _states(bars: DataFrame, order: str) -> DataFrame:
    """Bars with the reason against them, whether their day goes back, and their number among the good ones of their day, the last first. Windows by symbol
    come first, so that all are in one partitioning."""
    flagged = flag_malformed(bars)
    flagged = flagged.withColumn("__down", F.col("date") < F.lag("date").over(Window.partitionBy("symbol").orderBy(order)))
    w = Window.partitionBy("symbol", "date", F.col("reason").isNull()).orderBy(F.col(order).desc())
    return flagged.withColumn("__k", F.when(F.col("reason").isNull(), F.row_number().over(w)))


def _totals(bars: DataFrame) -> dict[str, Column]:
    fixed = F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("repaired"))), F.lit(0)) if "repaired" in bars.columns else F.lit(0).cast("long")
    return {"before": F.count("*"), "after": F.count_if(F.col("__k") == 1), "malformed": F.count_if(F.col("reason").isNotNull()), "duplicates": F.count_if(F.col("__k") > 1), "repaired_cells": fixed}


def repair(bars: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Good bars, the last of each (symbol, date), and a report by symbol: rows before and after, malformed, duplicates,
    whether dates were in order, repaired cells of valid rows (from a column ``repaired``, if there is one), status."""
    flagged = _states(bars, order)
    totals = _totals(bars) | {"was_sorted": F.count_if("__down") == 0}
    report = flagged.groupBy("symbol").agg(*[x.alias(c) for c, x in totals.items()]).select("symbol", "before", "after", "malformed", "duplicates", "was_sorted", "repaired_cells")
    same = (F.col("before") == F.col("after")) & (F.col("repaired_cells") == 0)
    report = report.withColumn("status", F.when(F.col("after") == 0, "error").when(same, F.when(F.col("was_sorted"), "clean").otherwise("sorted")).otherwise("repaired"))
    return flagged.where("__k = 1").drop("__k", "__down", "reason", "repaired"), report


#: What can be wrong with a bar: flag_malformed()'s reasons.
REASONS = ("date", "price", "range", "close")


def repair_into(bars: DataFrame, path: str, order: str = "seq") -> dict[str, int]:
    """Writes the good bars of repair() and returns its totals over all symbols, with the malformed ones by reason: metrics that the
    writing pass observes, so nothing is computed a second time for them."""
    seen = Observation()
    totals = _totals(bars) | {f"malformed_{r}": F.count_if(F.col("reason") == r) for r in REASONS}
    rows = _states(bars, order).observe(seen, *[x.alias(c) for c, x in totals.items()])
    rows.where("__k = 1").drop("__k", "__down", "reason", "repaired").write.parquet(path)
    return seen.get


#: Names of tables that hold no stock: fixed values.
NON_STOCK = ("SUMMARY", "META", "METADATA", "CONFIG", "DASHBOARD", "INDEX", "SHEET1")


def select_symbols(df: DataFrame, names: list[str] | None = None, exclude: tuple[str, ...] = NON_STOCK) -> DataFrame:
    """The rows of the named symbols in any case, of all without names; never of ``exclude``."""
    own = F.upper(F.trim(F.col("symbol").cast("string")))
    df = df.where(~own.isin(*exclude)) if exclude else df
    return df if names is None else df.where(own.isin([n.strip().upper() for n in names]))


def missing_symbols(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted rows whose symbol has no row, in any case and whatever blanks stand around it; a null is missing."""
    plain = F.upper(F.trim(F.col("symbol").cast("string")))
    there = df.select(plain.alias("__name")).distinct()
    return wanted.withColumn("__name", plain).join(there, "__name", "left_anti").drop("__name")


def newer_than(df: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Rows beyond each symbol's last date; all of a symbol without one."""
    return df.join(checkpoints.select("symbol", "last_date"), "symbol", "left").where(F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).drop("last_date")


def eligible(df: DataFrame, mode: str = "default", start: int = 20, refresh: bool = False) -> DataFrame:
    """Rows to forecast, from pos, predicted and forecast.

    They lie beyond a checkpoint, position ``start`` or a symbol's first predicted row if that is later, and
    aren't predicted or have a null forecast, or any of them with ``refresh``. all_eligible takes
    ``start`` alone as the checkpoint, force_all also every row beyond it, latest_only the last of the default ones."""
    return eligible_modes(df, ("refresh" if refresh and mode == "default" else mode,), start, refresh, "__mode").drop("__mode")


def eligible_modes(df: DataFrame, modes: tuple[str, ...], start: int = 20, refresh: bool = False, out: str = "mode") -> DataFrame:
    """The rows of eligible() for several modes, told by ``out``, from one pass over ``df``; the mode refresh is default with ``refresh``. A symbol's positions differ."""
    w = Window.partitionBy("symbol")
    df = df.withColumn("__mark", F.greatest(F.coalesce(F.min(F.when(F.col("predicted") == 1, F.col("pos"))).over(w), F.lit(start)), F.lit(start)))
    pos, beyond = F.col("pos"), F.col("pos") > F.col("__mark")
    wanted = F.lit(refresh) | (F.coalesce("predicted", F.lit(0)) == 0) | F.col("forecast").isNull()
    df = df.withColumn("__last", F.max(F.when(beyond & wanted, pos)).over(w))
    hits = {"default": beyond & wanted, "refresh": beyond, "latest_only": beyond & wanted & (pos == F.col("__last")), "all_eligible": (pos > start) & wanted, "force_all": pos > start}
    named = F.array_compact(F.array(*[F.when(hits[m], F.lit(m)) for m in modes]))
    return df.withColumn(out, F.explode(named)).drop("__mark", "__last")


def writable(df: DataFrame, skip_predicted: bool = True) -> DataFrame:
    ok = F.col("forecast").isNotNull() & ~F.isnan("forecast") & (F.abs("forecast") < float("inf"))
    return df.where(ok & (F.coalesce("predicted", F.lit(0)) == 0) if skip_predicted else ok)


def split_rolling(df: DataFrame, keep: int = 30) -> tuple[DataFrame, DataFrame]:
    """The newest ``keep`` dated rows of each symbol with all undated ones, and the rest to archive, the last of each date."""
    rows = rolling_parts(df, keep)
    return tuple(rows.where(F.col("part") == p).drop("part") for p in ("keep", "archive"))


def rolling_parts(df: DataFrame, keep: int = 30) -> DataFrame:
    """Both tables of split_rolling() as one, told by ``part`` (keep or archive), from one pass and one sort."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc_nulls_last(), F.col("seq").desc())
    rows = df.withColumns({"__k": F.row_number().over(w), "__after": F.lag("date").over(w)})
    # Newest first, a date's first row beyond the limit is its last one there.
    last = (F.col("__k") == keep + 1) | (F.col("date") != F.col("__after"))
    part = F.when(F.col("date").isNull() | (F.col("__k") <= keep), "keep").when(last, "archive")
    return rows.withColumn("part", part).where("part is not null").drop("__k", "__after")


def archive_report(df: DataFrame, archive: DataFrame, keep: int = 30) -> DataFrame:
    """By symbol: rows seen, undated ones (which stay), candidates beyond the newest ``keep``, those appended, those that the archive or a
    later row of the same day has, rows removed, oldest and newest appended day (of all candidates if none is), status and reason. Rows and archive meet in
    one window by symbol, so dealt alike they aren't dealt again."""
    rows = df.select("symbol", "date", "seq", F.lit(False).alias("__there"))
    there = archive.where("date is not null").select("symbol", "date", F.lit(None).cast(df.schema["seq"].dataType).alias("seq"), F.lit(True).alias("__there"))
    # Newest first, a day's archived row before its others.
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc_nulls_last(), F.col("__there").desc(), F.col("seq").desc())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.unionByName(there).withColumns({
        "__k": F.count(F.when(~F.col("__there"), 1)).over(upto), "__seen": F.last(F.when(F.col("__there"), F.col("date")), ignorenulls=True).over(upto), "__after": F.lag("date").over(w)})
    rows = rows.where(~F.col("__there")).withColumn("__old", F.col("date").isNotNull() & (F.col("__k") > keep))
    # Of a day with rows on both sides of the limit, the last one beyond it counts.
    last = (F.col("__k") == keep + 1) | ~F.col("date").eqNullSafe(F.col("__after"))
    rows = rows.withColumn("__new", F.col("__old") & ~F.col("__seen").eqNullSafe(F.col("date")) & last)
    over = lambda f, c: F.coalesce(f(F.when(F.col("__new"), F.col("date"))), f(F.when(F.col("__old"), F.col("date")))).alias(c)
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("rows_seen"), F.count_if(F.col("date").isNull()).alias("undated"), F.count_if("__old").alias("candidates"), F.count_if("__new").alias("appended"), over(F.min, "oldest"), over(F.max, "newest")
    )
    none, fresh = F.col("candidates") == 0, F.col("appended") > 0
    return out.withColumns({
        "duplicates": F.col("candidates") - F.col("appended"), "removed": F.col("candidates"), "status": F.when(none, "skipped").otherwise("ok"),
        "reason": F.when(none, "within the rolling window").when(fresh, "archived").otherwise("archive had all"),
    })


def unseen(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(existing.select(*keys), keys, "left_anti")


def chronological(df: DataFrame) -> DataFrame:
    """Undated rows first, in their order, then by date."""
    return df.orderBy(F.col("date").asc_nulls_first(), "seq")


def last_dates(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.max("date").alias("last_date"))


def detect_new(df: DataFrame, as_of: Column) -> DataFrame:
    """Days from each symbol's last date to a market date, and whether new rows are due."""
    return last_dates(df).withColumn("gap_days", F.datediff(as_of, "last_date")).withColumn("expect_new", F.col("gap_days") > 0)


def _listed(flags: dict[str, Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()])), ",")


def integrity_report(df: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """By symbol in row order: required columns without any value (or absent), dates, duplicate dates, whether they ascend, the problems as text, and ok. Duplicates follow one
    another by date, so that a task has a symbol's counts and sorted rows, but no table of all its dates."""
    w, by_date = Window.partitionBy("symbol").orderBy("seq"), Window.partitionBy("symbol").orderBy("date")
    rows = df.withColumns({"__down": F.col("date") < F.lag("date").over(w), "__again": F.col("date") == F.lag("date").over(by_date)})
    lacks = {c: F.count(c) == 0 if c in df.columns else F.count("*") >= 0 for c in required}
    out = rows.groupBy("symbol").agg(
        (_listed(lacks) if lacks else F.lit("")).alias("missing_columns"), F.count("date").alias("n_dates"), F.count_if("__again").alias("duplicate_dates"),
        (F.count_if("__down") == 0).alias("chronological"), (F.count("*") - F.count("date")).alias("blank_dates"),
    )
    problems = _listed({"columns": F.col("missing_columns") != "", "duplicates": F.col("duplicate_dates") > 0, "order": ~F.col("chronological"), "blanks": F.col("blank_dates") > 0})
    return out.withColumn("problems", problems).withColumn("ok", F.col("problems") == "")


def liveness_report(df: DataFrame, cols: list[str], labels: tuple[str, ...] = (), last: int = 5) -> DataFrame:
    """By symbol the required columns that the table lacks, those that are null in all of the last rows, whether any label
    column has a value, and ok."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    rows = df.withColumn("__k", F.row_number().over(w))
    have, told = [c for c in cols if c in df.columns], [c for c in labels if c in df.columns]
    recent = lambda c: F.count(F.when(F.col("__k") <= last, F.col(c)))
    out = rows.groupBy("symbol").agg(
        F.count_if(F.col("__k") <= last).alias("n_rows"), F.lit(",".join(c for c in cols if c not in have)).alias("missing_columns"),
        (_listed({c: recent(c) == 0 for c in have}) if have else F.lit("")).alias("dead_columns"), (sum((F.count(c) for c in told), F.lit(0)) > 0).alias("has_labels"),
    )
    return out.withColumn("ok", (F.col("missing_columns") == "") & (F.col("dead_columns") == ""))


def status_rollup(df: DataFrame) -> DataFrame:
    """By symbol from fetched, fresh, failed and skipped counts: a status; by run: all of them as one row, symbol null."""
    status = F.when(F.sum("failed") > 0, "error").when(F.sum("skipped") > 0, "skipped").when(F.sum("fresh") > 0, "updated").when(F.sum("fetched") > 0, "duplicate_only").otherwise("no_new_data")
    each = df.groupBy("symbol").agg(F.sum("fetched").alias("fetched"), F.sum("fresh").alias("fresh"), status.alias("status"))
    run = each.agg(F.sum("fetched").alias("fetched"), F.sum("fresh").alias("fresh"), F.when(F.count_if(F.col("status") == "error") == F.count("*"), "error").when(F.count_if(F.col("status") == "error") > 0, "partial_error").when(F.sum("fresh") > 0, "ok").otherwise("no_new_data").alias("status"))
    return each.unionByName(run.select(F.lit(None).cast(each.schema["symbol"].dataType).alias("symbol"), "fetched", "fresh", "status"))


def forecast_rollup(df: DataFrame) -> DataFrame:
    """By symbol from n_rows, n_eligible and n_written counts of a forecast run, with ``start`` the first position that has a
    full window: ok, no_new_data, or no_valid_start_point if the rows end before it; by run as one row, symbol null."""
    status = F.when(F.col("n_rows") <= F.col("start") + 1, "no_valid_start_point").when(F.col("n_written") > 0, "ok").otherwise("no_new_data")
    each = df.withColumn("status", status).select("symbol", "n_rows", "n_eligible", "n_written", "status")
    all_of = lambda s: F.count_if(F.col("status") == s)
    run = each.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_eligible").alias("n_eligible"), F.sum("n_written").alias("n_written"), F.when(all_of("ok") > 0, "ok").when(all_of("no_valid_start_point") == F.count("*"), "no_valid_start_point").otherwise("no_new_data").alias("status"))
    return each.unionByName(run.select(F.lit(None).cast(each.schema["symbol"].dataType).alias("symbol"), "n_rows", "n_eligible", "n_written", "status"))


def dataset_summary(examples: DataFrame, minimum: int = 1) -> DataFrame:
    """By symbol from part (train, validation, replay): counts, last date and why a symbol is skipped."""
    out = examples.groupBy("symbol").agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "validation", "replay")], F.max("date").alias("last_date"))
    return out.withColumn("skip_reason", F.when(F.col("n_train") + F.col("n_validation") == 0, "no new rows").when(F.col("n_train") < minimum, "too few rows"))


def drop_blank_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in which any of the text columns has more than white space."""
    return df.where(F.exists(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols]), lambda x: x != ""))
