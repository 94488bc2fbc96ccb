"""Doubles rounded alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Moves exact ties, which the two round differently, off the boundary; 0.0 is added at the end as one returns -0.0.
NUDGE = 3e-7


def nudged(c: Column, digits: int) -> Column:
    """round(c + NUDGE, digits) + 0.0, halves away from 0; by whole numbers where those hold it, as round() makes a decimal of each double."""
    x, unit = c + NUDGE, 10.0**digits
    return F.when(F.abs(x) < 1e9, F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit).otherwise(F.round(x, digits)) + 0.0


def rounded(df: DataFrame, *cols: str, digits: int = 4, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """The columns with doubles rounded and dates as text."""
    kinds = dict(df.dtypes)

    def plain(c: str):
        if kinds[c] == "double":
            return nudged(F.col(c), digits).alias(c)
        return F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c)

    return df.select(*[plain(c) for c in (*keys, *cols)])


def sql_round(expr: str, name: str, digits: int = 4) -> str:
    return f"round(({expr}) + {NUDGE:.7f}, {digits}) + 0.0::DOUBLE AS {name}"
