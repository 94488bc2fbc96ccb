"""Whitening of embeddings by block matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import broadcast_if_small, cut
from quantloom.llm.vectors import finite, width

#: Rows of a block, and blocks that one task multiplies and adds up.
BLOCK_ROWS, TASK_BLOCKS = 1024, 8
#: Components whose share of the largest eigenvalue is below this are noise of rounding: directions in which the vectors don't differ.
LEAST_SHARE = 1e-11


def blocks(df: DataFrame, n: int, wide: int) -> BlockMatrix:
    """Rows (index from 0 without gaps, values array<double>) as blocks of BLOCK_ROWS rows, dealt over the executors."""
    rows = MLUtils.convertVectorColumnsFromML(df.select("index", array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(rows, n, wide).toBlockMatrix(BLOCK_ROWS, wide)


def covariance(m: BlockMatrix, n: int) -> np.ndarray:
    """Transpose times matrix over ``n``, of centred rows. The rows are the products' middle dimension, so it is cut into splits: a
    task multiplies and adds up TASK_BLOCKS blocks, and sums of the result's size meet."""
    splits = max(1, -(-m.numRowBlocks // TASK_BLOCKS))
    left, right = m.transpose()._java_matrix_wrapper, m._java_matrix_wrapper
    product = BlockMatrix(left.call("multiply", right._java_model, splits), m.colsPerBlock, m.colsPerBlock)
    return product.toLocalMatrix().toArray() / n


def numbered(df: DataFrame) -> DataFrame:
    """A written table's rows with ``index`` from 0 without gaps in place of ``uid``, which monotonically_increasing_id() made: rows are
    counted by the task that wrote them and moved up by the tasks before."""
    rows = df.withColumns({"_task": F.shiftright("uid", 33), "_place": F.col("uid").bitwiseAND((1 << 33) - 1)}).drop("uid")
    sizes = rows.groupBy("_task").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut(sizes.select("_task", F.coalesce(before, F.lit(0)).alias("_before")), "tasks")
    return rows.join(broadcast_if_small(sizes, 32), "_task").withColumn("index", F.col("_before") + F.col("_place")).drop("_task", "_place", "_before")


def whiten(df: DataFrame, components: int = 32, vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Rows with a finite vector, in whole numbers floor(scale * c) + shift, projected on the unit eigenvectors of their covariance and
    scaled to unit variance: adds ``n``, ``deviation``, ``whitened`` (array by falling eigenvalue), ``explained`` (array) and ``identity_error``.

    The vectors' exact sums S and number n are counted first, so rows are centred as (n * x - S) / n, whose numerator is a whole number. Centred rows are
    indexed into distributed blocks; their transpose-multiply gives the covariance, whose eigenvectors are found
    on the driver (its size is the dimension's square), and a block multiplication by the whitening matrix projects all rows. ``identity_error`` is
    measured on the whitened rows, by the same block product.

    Rows with a null vector, or a null or non-finite entry, go; null ids stay and repeated rows each count. Fewer than
    ``components`` are returned where the vectors have fewer dimensions or don't differ in so many directions (none for a single row; the arrays are empty then).
    Unequal lengths are an error, as are vectors so many or so long that ``deviation`` passes 2^63. An empty table
    gives an empty one. Other columns stay but for ones with the results' names.
    """
    names = [c for c in df.columns if c not in (vector_col, "n", "deviation", "whitened", "explained", "identity_error")]
    spark, whole = df.sparkSession, F.transform(vector_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(shift))
    kept = cut(df.where(finite(vector_col)).select(F.struct(*names).alias("row"), whole.alias("x"), F.monotonically_increasing_id().alias("uid")), "vectors")
    wide = width(kept, "x")
    n, *sums = kept.agg(F.count("*"), *[F.sum(F.col("x")[i]) for i in range(wide)]).first()
    out = lambda rows, explained, error: rows.select("row.*", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    apart = F.zip_with("x", F.lit(sums or [0]).cast("array<long>"), lambda x, s: F.lit(n).cast("long") * x - s) if n and wide else F.array().cast("array<long>")
    deviation = F.aggregate("apart", F.lit(0).cast("long"), lambda a, y: a + y * y)
    rows = numbered(kept.select("row", "uid", apart.alias("apart"))).select("row", "index", deviation.alias("deviation"), F.transform("apart", lambda y: y.cast("double") / n).alias("values"))
    if not (n and wide):
        return out(rows.withColumn("whitened", F.array().cast("array<double>")), [], 0.0)
    centred = blocks(rows.select("index", "values"), n, wide)
    variance = covariance(centred, n)
    values, vectors = np.linalg.eigh((variance + variance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > max(values[0], 0) * LEAST_SHARE).sum())
    if not k:
        return out(rows.withColumn("whitened", F.array().cast("array<double>")), [], 0.0)
    by = vectors[:, :k] / np.sqrt(values[:k])
    matrix = IndexedRowMatrix(spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(by)], ["index", "vector"]), wide, k).toBlockMatrix(wide, k)
    projected = callMLlibFunc("getIndexedRows", centred.multiply(matrix).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    white = cut(rows.drop("values").join(projected.select("index", vector_to_array("vector").alias("whitened")), "index"), "whitened")
    means = white.agg(*[F.avg(F.col("whitened")[i]) for i in range(k)]).first()
    again = blocks(white.select("index", F.zip_with("whitened", F.lit(list(means)), lambda a, m: a - m).alias("values")), n, k)
    error = float(np.abs(covariance(again, n) - np.eye(k)).max())
    return out(white, (values[:k] / np.trace(variance)).tolist(), error)
