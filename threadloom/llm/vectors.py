"""What the two vector searches share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import materialise


def usable(df: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, vector as doubles) of rows with a sound vector; `zero` admits zero vectors.

    Null ids, null or empty vectors, and vectors that hold a null or non-finite component take no part, nor do vectors
    whose length is not the most common one (the smaller of two). Equal rows count once.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    if not zero:
        ok = ok.where(F.exists("embedding", lambda x: x != 0))
    ok = materialise(ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).distinct(), "vectors")
    common = ok.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return ok.where(F.size("vector") == (common.d if common else 0))


def sound(df: DataFrame, *carry: str) -> DataFrame:
    """The columns `carry` and the vector as doubles of every row whose vector is there and holds no null or non-finite component.

    Vectors whose length is not the most common one (the smaller of two) are left out; repeated rows stay.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col("embedding").isNotNull() & ~bad).select(*(F.col(c).cast("long").alias(c) if c == "vec_id" else c for c in carry), F.col("embedding").cast("array<double>").alias("vector"))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (common.d if common else 0))


def matrix(column) -> np.ndarray:
    """Rows of a list column of pandas as a matrix."""
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of scores the k largest, ties to the smaller id, without the row's own id: (row, column, score)."""
    s = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    if s.shape[1] > 4 * k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, col = np.nonzero(s >= kth[:, None])
    else:
        row, col = np.nonzero(np.ones_like(s, bool))
    v = s[row, col]
    fine = v > -np.inf
    row, col, v = row[fine], col[fine], v[fine]
    order = np.lexsort((ids[col], -v, row))
    row, col, v = row[order], col[order], v[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep], v[keep]
