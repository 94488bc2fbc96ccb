"""Helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector_col: str) -> Column:
    """Whether a vector is there and all its entries are there and finite."""
    return F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def width(df: DataFrame, vector_col: str) -> int:
    """The length that all vectors have, 0 where there are none; vectors of other lengths are an error."""
    least, most = df.agg(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} entries")
    return least or 0


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    """An Arrow column of lists of ``wide`` numbers as rows of doubles."""
    return pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), wide)
