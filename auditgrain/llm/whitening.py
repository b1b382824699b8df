"""Whitening of embeddings with distributed block matrices.

Entries become integers, so that means and deviations are exact. Centred rows are indexed into the
blocks of an MLlib BlockMatrix; its transpose times itself is the scatter matrix, summed from as many
partial products as there are blocks of rows. Only that matrix, dimensions squared, reaches the driver
for the eigenvectors; a second block product projects the rows on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditgrain.session import materialize

#: Entries at or beyond this size count as not finite: their integers and sums would leave a long.
LARGEST = float(1 << 20)
SCALE, SHIFT = 1024, 100_000
#: A component whose share of the largest eigenvalue is below this has no variance beyond rounding.
NO_VARIANCE = 1e-13


@dataclass(frozen=True)
class Blocks:
    """Size of blocks: `rows` by `columns`, and at most so many partial products of a scatter matrix."""

    rows: int = 4096
    columns: int = 1024
    partial: int = 64


def usable(vector: str = "embedding") -> Column:
    """The vector is there, not empty, and all entries are numbers."""
    spoiled = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return F.coalesce((F.size(vector) > 0) & ~spoiled, F.lit(False))


def integers(vector: str = "embedding") -> Column:
    """floor(1024 * c) + 100000 of every entry c."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE) + SHIFT)


def indexed(df: DataFrame, name: str) -> DataFrame:
    """The rows with `index`, 0 to n - 1, written to the shared folder so that a lost task finds the same again.

    A row's place in its partition comes with the write; what joins the partitions is one number each.
    """
    at = F.monotonically_increasing_id()
    held = materialize(df.withColumn("_at", at), name)
    part = F.shiftright("_at", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = held.withColumn("_part", part).join(starts, "_part")
    return placed.withColumn("index", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")


def block_matrix(rows: DataFrame, vector: str, n: int, dimensions: int, blocks: Blocks) -> BlockMatrix:
    """The block matrix of (index, array of doubles); rows go to MLlib inside the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dimensions).toBlockMatrix(blocks.rows, blocks.columns)


def scatter(matrix: BlockMatrix, blocks: Blocks) -> np.ndarray:
    """Transpose times matrix, on the driver: dimensions squared.

    The middle dimension is split, so that partial products are made where their rows are and only
    those, not the rows, meet in one task.
    """
    parts = max(1, min(blocks.partial, matrix.numRowBlocks))
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def local_block(spark: SparkSession, values: np.ndarray, blocks: Blocks) -> BlockMatrix:
    """A small matrix as blocks that fit behind those of the rows."""
    size = blocks.columns
    cut = [
        ((i // size, j // size), DenseMatrix(*part.shape, part.ravel(order="F")))
        for i in range(0, values.shape[0], size) for j in range(0, values.shape[1], size)
        for part in [values[i : i + size, j : j + size]]
    ]
    return BlockMatrix(spark.sparkContext.parallelize(cut, 1), size, size, *values.shape)


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """(index, array of doubles) of a block matrix, without a detour over Python."""
    indexed_rows = matrix.toIndexedRowMatrix()  # held by name until the call is over: the JVM forgets what Python drops
    found = callMLlibFunc("getIndexedRows", indexed_rows._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("values"))


def _per_dimension(rows: DataFrame, vector: str, total: Column) -> list:
    """One value for each dimension, in order; `total` aggregates the column `x`."""
    entries = rows.select(F.posexplode(vector).alias("i", "x"))
    return [r[1] for r in entries.groupBy("i").agg(total.alias("t")).orderBy("i").collect()]


def whiten(df: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding", blocks: Blocks = Blocks()) -> DataFrame:
    """One row for each usable vector and component up to `components` (or the dimensions, if fewer).

    Columns: the key, `component` (from 1, by falling eigenvalue), `n` vectors, `deviation` (sum over
    dimensions of (n*x - S)^2, exact; null beyond a long), `whitened` (the centred vector on the unit
    eigenvector, over the root of its eigenvalue), `explained` (its share of the trace) and
    `identity_error` (largest entry of the whitened covariance minus the identity, the same in all rows).

    Rows whose vector is null or empty, or holds a null, non-finite or huge entry (2^20 or more), go. The
    dimension is the most frequent length of the others, the longest of equals; other lengths have no
    place in the matrix and go too. A component without variance has a null `whitened` and does not
    count for the error; without any variance `explained` and the error are null. Repeated rows and keys,
    null keys included, are rows of their own. An empty table gives an empty one. Further columns are
    left out, so that names cannot clash.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = df.filter(usable(vector)).select(F.col(key).alias("key"), integers(vector).alias("x"))
    sizes = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    shape = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).limit(1).collect()
    if not shape:
        return spark.createDataFrame([], schema)
    d, n = shape[0]
    held = indexed(kept.filter(F.size("x") == d), "vectors")
    sums = F.array(*[F.lit(int(s)).cast("long") for s in _per_dimension(held, "x", F.sum("x"))])

    # n*x - S is exact, so a centred entry is rounded once
    away = held.select("index", "key", F.zip_with("x", sums, lambda x, s: x * n - s).alias("away"))
    centred = away.select("index", F.transform("away", lambda x: x.cast("double") / n).alias("c"))
    rows = block_matrix(centred, "c", n, d, blocks)
    covariance = scatter(rows, blocks) / n
    trace = float(np.trace(covariance))
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    values, vectors = values[order], vectors[:, order]
    live = values > max(values[0], 0) * NO_VARIANCE
    roots = np.where(live, np.sqrt(np.where(live, values, 1)), 1)
    whitening = np.where(live, vectors / roots, 0)

    white = materialize(rows_of(rows.multiply(local_block(spark, whitening, blocks))), "whitened")
    error = None
    if live.any():
        mean = F.array(*[F.lit(float(m)) for m in _per_dimension(white, "values", F.avg("x"))])
        again = white.select("index", F.zip_with("values", mean, lambda x, m: x - m).alias("c"))
        seen = scatter(block_matrix(again, "c", n, len(order), blocks), blocks) / n
        error = float(np.abs(seen - np.eye(len(order)))[np.ix_(live, live)].max())

    of = F.array(*[
        F.struct(F.lit(k + 1).alias("component"), F.lit(bool(live[k])).alias("live"), F.lit(float(values[k] / trace) if trace > 0 else None).cast("double").alias("explained"))
        for k in range(len(order))
    ])
    square = F.aggregate("away", F.lit(0).cast("long"), lambda a, x: F.try_add(a, F.try_multiply(x, x)))
    both = away.select("index", "key", square.alias("deviation")).join(white, "index")
    each = both.select("key", "deviation", F.explode(F.arrays_zip(of.alias("of"), F.col("values").alias("v"))).alias("e"))
    return each.select(
        F.col("key").alias(key), F.col("e.of.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.col("e.of.live"), F.col("e.v")).alias("whitened"), F.col("e.of.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
