"""Whitening of vectors with MLlib's BlockMatrix.

Components become integers, x = floor(64 * c) + 1000000; the fit list is all rows
with a sound vector. Rows are numbered without gaps and centred, their blocks lie
on the executors, and the transposed matrix times itself is the scatter: the
blocks meet in `splits` shares, whose sums are one small matrix. Its eigenvectors
come from the driver, of one dimension squared, and a second product projects all
blocks on the components over the roots of their eigenvalues.

Rows whose vector is null or holds a null or non-finite component go, and so do
vectors whose length is not the commonest one (of equally common ones the
smaller). Null and repeated ids and repeated rows count as rows of their own; an
empty table gives no rows; other columns are ignored, whatever their names. A
component without variance (beside the trace, to double precision) has 0 for
`whitened` and is left out of `identity_error`. A `deviation` beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from .common import materialise
from .vectors import sound

SCALE, OFFSET, MOST = 64, 1_000_000, 32
#: Rows and columns of a block.
BLOCK = 1024
#: Share of the trace below which an eigenvalue is none.
LEAST = 1e-13


@dataclass(frozen=True)
class Whitening:
    """Centre (sums over `n` rows), components as columns with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def weights(self) -> np.ndarray:
        """The matrix that whitens centred rows."""
        sound = self.values > LEAST * self.trace
        return self.axes * np.where(sound, 1 / np.sqrt(np.where(sound, self.values, 1)), 0)


def numbered(rows: DataFrame) -> DataFrame:
    """Stored rows with `row`, from 0 and without gaps, by the counts of the partitions."""
    stored = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = stored.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row per task
    base, starts = 0, []
    for r in counts:
        starts.append((r.part, base))
        base += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "part long, base long")
    return stored.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("row", F.col("base") + place).drop("part", "base", "at")


def totals(rows: DataFrame, dim: int) -> list[int]:
    """Exact sums of the integers in `x` by position."""

    def run(batches):
        total = np.zeros(dim, np.int64)
        for batch in batches:
            total += batch.column("x").flatten().to_numpy().reshape(batch.num_rows, dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total)], names=["k", "s"])

    found = rows.select("x").mapInArrow(run, "k int, s long").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row per dimension
    return [int(r.s) for r in sorted(found)]


def blocks(rows: DataFrame, n: int, dim: int) -> BlockMatrix:
    """Rows (row, v) as a distributed matrix of blocks."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(indexed, n, dim).toBlockMatrix(BLOCK, BLOCK)


def scatter(m: BlockMatrix, splits: int) -> np.ndarray:
    """The transposed matrix times itself; only this product, one dimension squared, comes to the driver."""
    java = m._java_matrix_wrapper._java_model
    # Each share of the rows' blocks is multiplied and summed by a task of its own.
    product = BlockMatrix(java.transpose().multiply(java, splits), BLOCK, BLOCK)
    return product.toLocalMatrix().toArray()


def centre_of(n: int, sums: list[int]) -> np.ndarray:
    return np.array([s / n for s in sums])


def projected(m: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(row, w) of the matrix times the weights, which are a few blocks."""
    sc = m.blocks.context
    dim, k = weights.shape
    parts = [((i // BLOCK, 0), Matrices.dense(*weights[i : i + BLOCK].shape, weights[i : i + BLOCK].flatten(order="F"))) for i in range(0, dim, BLOCK)]
    right = BlockMatrix(sc.parallelize(parts, 1), BLOCK, BLOCK, dim, k)
    rows = callMLlibFunc("getIndexedRows", m.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("w"))


def whiten(df: DataFrame, most: int = MOST) -> tuple[DataFrame, Whitening | None, float]:
    """(row, vec_id, x, whitened) of all sound rows, the fit, and the largest absolute entry of whitened's covariance less the identity."""
    spark = df.sparkSession
    rows = sound(df, "vec_id")
    first = rows.select(F.size("vector").alias("d")).first()
    if first is None or first.d <= 0:
        return spark.createDataFrame([], "row long, vec_id long, x array<long>, whitened array<double>"), None, 0.0
    dim = first.d
    x = F.transform("vector", lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    rows = numbered(rows.select("vec_id", x.alias("x")))
    n, sums = rows.count(), totals(rows, dim)
    splits = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def centred(values, centre):
        return F.zip_with(values, F.lit([float(c) for c in centre]), lambda v, c: v - c)

    matrix = blocks(rows.select("row", centred("x", centre_of(n, sums)).alias("v")), n, dim)
    v = scatter(matrix, splits) / n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    down = np.argsort(values)[::-1][:most]
    fit = Whitening(n, sums, axes[:, down], np.maximum(values[down], 0), float(np.trace(v)))
    white = materialise(projected(matrix, fit.weights()), "whitened")
    # What the rows themselves have: their covariance, centred again.
    means = _means(white, len(down))
    own = scatter(blocks(white.select("row", centred("w", means).alias("v")), n, len(down)), splits) / n
    varied = np.flatnonzero(fit.values > LEAST * fit.trace)
    off = float(np.abs(own[np.ix_(varied, varied)] - np.eye(len(varied))).max(initial=0))
    out = rows.join(white.withColumnRenamed("w", "whitened"), "row").select("row", "vec_id", "x", "whitened")
    return out, fit, off


def _means(rows: DataFrame, k: int) -> np.ndarray:
    def run(batches):
        total, n = np.zeros(k), 0
        for batch in batches:
            total += batch.column("w").flatten().to_numpy().reshape(batch.num_rows, k).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total), pa.array([n] * k)], names=["k", "s", "n"])

    found = rows.select("w").mapInArrow(run, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("m")).collect()
    return np.array([r.m for r in sorted(found)])


def components(df: DataFrame, most: int = MOST) -> DataFrame:
    """A row per sound row and component: vec_id, component (from 1), n, deviation (sum over dimensions of (n * x - S)^2, exact), whitened, explained, identity_error."""
    rows, fit, off = whiten(df, most)
    n, sums = (fit.n, fit.sums) if fit else (0, [])
    gap = F.zip_with("x", F.lit(sums).cast("array<long>") if sums else F.array().cast("array<long>"), lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), s))
    deviation = F.aggregate(gap, F.lit(0).cast("long"), lambda t, g: F.try_add(t, F.try_multiply(g, g)))
    share = [float(e / fit.trace) if fit.trace else 0.0 for e in fit.values] if fit else []
    explained = F.get(F.lit(share) if share else F.array().cast("array<double>"), F.col("component") - 1)
    out = rows.select("vec_id", deviation.alias("deviation"), F.posexplode("whitened").alias("component", "whitened")).withColumn("component", F.col("component") + 1)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(off).alias("identity_error"))
