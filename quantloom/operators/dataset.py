"""Training sets without leakage: splits, masks, scalers, sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.blocks import with_halo
from quantloom.operators.indicators import by_symbol


def fit_scaler(df: DataFrame, cols: list[str], until: str) -> DataFrame:
    """Minimum and maximum of each column by symbol over the rows where ``until`` holds."""
    rows = df.where(until)
    return rows.groupBy("symbol").agg(*[f(c).alias(f"{c}_{name}") for c in cols for f, name in ((F.min, "min"), (F.max, "max"))])


def apply_scaler(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min), with 1 for a range of 0."""
    out = df.join(params, "symbol", "left")
    scale = lambda c: F.when(F.col(f"{c}_max") == F.col(f"{c}_min"), 1.0).otherwise(F.col(f"{c}_max") - F.col(f"{c}_min"))
    out = out.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"{c}_min")) / scale(c) for c in cols})
    return out.drop(*[f"{c}_{k}" for c in cols for k in ("min", "max")])


def inverse_scale(df: DataFrame, params: DataFrame, col: str, scaled: str, out: str) -> DataFrame:
    joined = df.join(params.select("symbol", f"{col}_min", f"{col}_max"), "symbol", "left")
    scale = F.when(F.col(f"{col}_max") == F.col(f"{col}_min"), 1.0).otherwise(F.col(f"{col}_max") - F.col(f"{col}_min"))
    return joined.withColumn(out, F.col(scaled) * scale + F.col(f"{col}_min")).drop(f"{col}_min", f"{col}_max")


def date_split(df: DataFrame, train: tuple[str, str], test: tuple[str, str], backtest: tuple[str, str]) -> DataFrame:
    """Train and backtest include both ends, test leaves out its end."""
    d = F.col("date")
    lit = lambda x: F.to_date(F.lit(x))
    return df.withColumn("split", F.when(d.between(lit(train[0]), lit(train[1])), "train").when((d >= lit(test[0])) & (d < lit(test[1])), "test").when(d.between(lit(backtest[0]), lit(backtest[1])), "backtest"))


def realised_mask(df: DataFrame, horizon: int, split_end: str) -> DataFrame:
    """The day on which the label of ``horizon`` is known, and whether that is within the split."""
    day = F.lead("date", horizon - 1).over(by_symbol())
    return df.withColumn("realised_date", day).withColumn("realised", F.coalesce(F.col("realised_date") <= F.to_date(F.lit(split_end)), F.lit(False)))


def _counted(df: DataFrame, *within: str) -> DataFrame:
    w = Window.partitionBy("symbol", *within)
    return df.withColumns({"__i": F.row_number().over(w.orderBy("date")) - 1, "__n": F.count("*").over(w)})


def embargo_split(df: DataFrame, share: float = 0.10, gap: int = 5) -> DataFrame:
    """The last ceil(share n) rows validate, the ``gap`` before them are left out, the rest fits; all fits if n <= gap + 2."""
    df = _counted(df)
    first = F.col("__n") - F.ceil(F.col("__n") * share)
    part = F.when(F.col("__n") <= gap + 2, "fit").when(F.col("__i") >= first, "validation").when(F.col("__i") >= first - gap, "embargo").otherwise("fit")
    return df.withColumn("part", part).drop("__i", "__n")


def ratio_split(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    df = _counted(df)
    part = F.when(F.col("__i") < F.floor(F.col("__n") * train), "train").when(F.col("__i") < F.floor(F.col("__n") * (train + val)), "validation").otherwise("test")
    return df.withColumn("part", part).drop("__i", "__n")


def _sampled(k: int) -> Column:
    """Whether row __i of __n is one of k evenly spaced ones."""
    steps = F.lit(1.0 if k == 1 else k - 1.0)
    # Row i is taken if some j < k has floor(j (n - 1) / (k - 1)) = i.
    j = F.ceil(F.col("__i") * steps / F.nullif(F.col("__n") - 1, F.lit(0)))
    hit = (j < k) & (F.floor(j * (F.col("__n") - 1) / steps) == F.col("__i"))
    return (F.col("__n") <= k) | (F.col("__i") == 0 if k == 1 else hit)


def even_sample(df: DataFrame, k: int) -> DataFrame:
    """Of each symbol k rows evenly spaced from first to last, all if there are no more; one is the first."""
    return _counted(df).where(_sampled(k)).drop("__i", "__n")


def incremental_examples(df: DataFrame, checkpoints: DataFrame, val: int = 5, replay: int = 12) -> DataFrame:
    """New rows beyond each symbol's checkpoint: the last min(val, max(1, n / 3)) validate, the others
    train; an even sample of ``replay`` older rows is added to them. A symbol without checkpoint is all new. New and old rows are numbered
    in one window, so ``df`` is read once."""
    rows = df.join(checkpoints.select("symbol", "last_date"), "symbol", "left")
    rows = rows.withColumn("__new", F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))).where("__new is not null")
    rows = _counted(rows, "__new")
    held = F.least(F.lit(val), F.greatest(F.lit(1), F.floor(F.col("__n") / 3)))
    part = F.when(~F.col("__new"), "replay").when(F.col("__i") >= F.col("__n") - held, "validation").otherwise("train")
    return rows.where(F.col("__new") | _sampled(replay)).withColumn("part", part).drop("__i", "__n", "__new", "last_date")


def sequences(df: DataFrame, cols: list[str], n: int = 20, include_anchor: bool = True) -> DataFrame:
    """The last n rows of ``cols`` up to the row, or before it, as an array of arrays; rows without n finite ones go."""
    frame = by_symbol().rowsBetween(-(n - 1), 0) if include_anchor else by_symbol().rowsBetween(-n, -1)
    finite = F.forall(F.array(*cols), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.withColumn("__row", F.when(finite, F.array(*[F.col(c).cast("double") for c in cols])))
    return df.withColumn("features", F.collect_list("__row").over(frame)).where(F.size("features") == n).drop("__row")


def tail(df: DataFrame, k: int) -> DataFrame:
    """Sequences cut to their last k steps."""
    return df.withColumn("features", F.slice("features", -k, k))


def override_last(df: DataFrame, feature: int, value: str) -> DataFrame:
    """One feature of the last step replaced by a column's value."""
    return df.withColumn("features", F.transform("features", lambda row, i: F.when(i == F.size("features") - 1, F.transform(row, lambda x, k: F.when(k == feature, F.col(value)).otherwise(x))).otherwise(row)))


def advance_checkpoints(checkpoints: DataFrame, trained: DataFrame) -> DataFrame:
    """The last trained date by symbol, where there are training rows; others stay."""
    new = trained.where("part = 'train'").groupBy("symbol").agg(F.max("date").alias("last_date"))
    return checkpoints.unionByName(new).groupBy("symbol").agg(F.max("last_date").alias("last_date"))


def common_features(df: DataFrame, cols: list[str]) -> list[str]:
    """The columns that have a value in every symbol: one aggregate, one row."""
    has = df.groupBy("symbol").agg(*[(F.count(c) > 0).alias(c) for c in cols]).agg(*[F.bool_and(c).alias(c) for c in cols]).first()
    return [c for c in cols if has[c]]


def score_sequences(df: DataFrame, keys: list[str], model: Callable[[], Callable[[np.ndarray], np.ndarray]], horizons: int = 5) -> DataFrame:
    """A row a (keys, horizon) with pred, from a model on the ``features`` of sequences(): ``model()`` is made once a task
    and maps an array (rows, steps, features) to (rows, horizons). Sequences of one batch have one shape."""
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", horizon int, pred double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model()
        for rows in batches:
            if rows.num_rows:
                seqs = rows.column("features")
                steps = seqs.flatten()
                if any(pc.count_distinct(pc.list_value_length(x), mode="all").as_py() != 1 for x in (seqs, steps)):
                    raise ValueError("sequences of one batch have one shape")
                values = np.array(pc.cast(steps.flatten(), pa.float64()).to_numpy(zero_copy_only=False))
                out = np.asarray(score(values.reshape(rows.num_rows, len(steps) // rows.num_rows, -1)), float)[:, :horizons]
                place = pa.array(np.repeat(np.arange(rows.num_rows), horizons))
                h = pa.array(np.tile(np.arange(1, horizons + 1, dtype="i4"), rows.num_rows))
                yield pa.record_batch([*[rows.column(k).take(place) for k in keys], h, pa.array(out.ravel())], names=[*keys, "horizon", "pred"])

    return df.select(*keys, "features").mapInArrow(run, schema)


def sequence_blocks(df: DataFrame, cols: list[str], n: int = 20, include_anchor: bool = True, size: int = 4096) -> DataFrame:
    """The sequences of sequences() without their n-fold copy: a row a block of ``size`` bars of a symbol, with the rows before it that its first sequences
    reach back to: (symbol, block, rows), rows an array of (date, own, values) in order of their dates. A symbol's bars are cut by ranges, so no task has a long one whole, and
    sequences are cut out of a block where they are read (score_blocks)."""
    values = F.array(*[F.col(c).cast("double") for c in cols])
    rows = with_halo(df.select("symbol", "date", values.alias("values")), size, n - 1 if include_anchor else n)
    return rows.groupBy("symbol", "block").agg(F.array_sort(F.collect_list(F.struct("date", "own", "values"))).alias("rows"))


def score_blocks(blocks: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], n: int = 20, include_anchor: bool = True, horizons: int = 5, batch: int = 1024) -> DataFrame:
    """score_sequences() over sequence_blocks() with the same ``n`` and ``include_anchor``: (symbol, date, horizon, pred). The model gets ``batch`` sequences at a time as a view of their
    block; sequences with a value that is null or not finite go."""
    kinds = {f.name: f.dataType for f in blocks.schema["rows"].dataType.elementType}
    schema = f"symbol {blocks.schema['symbol'].dataType.simpleString()}, date {kinds['date'].simpleString()}, horizon int, pred double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, skip = model(), 0 if include_anchor else 1
        for rows in batches:
            for k in range(rows.num_rows):
                own = rows.column("rows").slice(k, 1).flatten()
                values = pc.cast(own.field("values").flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(own), -1)
                if len(values) < n + skip:
                    continue
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(values).all(1))])
                ends = np.arange(n - 1 + skip, len(values))  # the rows that the sequences are of
                last = ends - skip
                keep = (bad[last + 1] == bad[last + 1 - n]) & own.field("own").to_numpy(zero_copy_only=False)[ends]
                views = np.lib.stride_tricks.sliding_window_view(values, n, axis=0).transpose(0, 2, 1)
                for at in np.split(np.flatnonzero(keep), range(batch, int(keep.sum()), batch)):
                    if len(at):
                        out = np.asarray(score(views[at]), float)[:, :horizons]
                        place = pa.array(np.repeat(ends[at], horizons))
                        symbol = rows.column("symbol").take(pa.array(np.full(len(place), k)))
                        yield pa.record_batch([symbol, own.field("date").take(place), pa.array(np.tile(np.arange(1, horizons + 1, dtype="i4"), len(at))), pa.array(out.ravel())], names=["symbol", "date", "horizon", "pred"])

    return blocks.select("symbol", "rows").mapInArrow(run, schema)


def momentum(steps: int = 5) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """The default sequence model: the mean change of the last feature, carried on."""
    return lambda: lambda x: np.diff(x[:, :, -1], axis=1).mean(1, keepdims=True) * np.arange(1, steps + 1)
