"""Approximate nearest neighbours over several shifted Hilbert orderings.

For the largest inner product, vectors x are lifted onto a sphere of radius M
(the largest norm) by one more component, and queries are scaled to it: the
nearest point is then the largest product. Each curve projects onto four
orthonormal directions of its own, maps every coordinate to a grid by quantiles
of a sample, shifts it, and takes the Hilbert index as key. Vectors and queries
are range-partitioned and sorted by (curve, key); a query looks at all vectors
within `window` times their number on either side, in blocks of fixed size, and
the neighbouring blocks of all curves merge and are ranked by exact products.

The window is a share of the table: vectors without structure have no smaller
neighbourhood that holds nine tenths of the nearest. Where vectors cluster, a
smaller share does. Of rows with equal vectors only the k + 1 smallest ids are
candidates: they precede all others in every result, also where one of them is
the query itself, so ties are exact however many rows share a vector. Equal keys
are told apart by a hash of curve and id.

Null ids and unsound vectors take no part (see vectors.usable); equal rows count
once, an empty table gives no rows, and other columns are ignored. An id that
stands for several different vectors is a candidate with each of them; as a query
it is searched by each, and a candidate counts with its best score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, slices
from .vectors import best, matrix, usable

DIMS, BITS, BLOCK, QUERY_ROWS = 4, 8, 8192, 4096


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of grid coordinates (Skilling's transposition)."""
    x, d = grid.astype(np.int64).T.copy(), grid.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            bit = (x[i] & q) != 0
            swap = np.where(bit, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(bit, q - 1, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b) & 1
    return key


class Curves:
    """Projections, quantile grids and shifts of all curves, from a sample of lifted vectors."""

    def __init__(self, sample: np.ndarray, n: int, seed: int):
        rng, d = np.random.default_rng(seed), sample.shape[1]
        axes: list[np.ndarray] = []
        while len(axes) < n * DIMS:
            axes += [*np.linalg.qr(rng.normal(size=(d, d)))[0].T]
        self.axes = np.stack(axes[: n * DIMS]).reshape(n, DIMS, d)
        self.cuts = np.quantile(np.einsum("ckd,sd->cks", self.axes, sample), np.linspace(0, 1, 257)[1:-1], axis=2)  # cuts x curves x dims
        self.shift = rng.random((n, DIMS))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Rows x curves."""
        out = np.empty((len(x), len(self.axes)), np.int64)
        for c, axes in enumerate(self.axes):
            y = x @ axes.T
            level = np.column_stack([np.searchsorted(self.cuts[:, c, k], y[:, k]) for k in range(DIMS)]) / 256
            out[:, c] = hilbert(np.minimum((0.75 * level + 0.25 * self.shift[c]) * (1 << BITS), (1 << BITS) - 1).astype(np.int64))
        return out


def search(df: DataFrame, is_query: Column, k: int = 20, curves: int = 8, window: float = 0.1, sample: int = 4000, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found per query; is_query is a condition on vec_id."""
    spark = df.sparkSession
    data = usable(df, zero=False)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    top = data.agg(F.max(norm).alias("m"), F.count(F.when(is_query, 1)).alias("q")).first()
    radius = float(np.sqrt(top.m or 1.0))
    rows = data.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).collect()  # bounded
    lift = lambda x: np.column_stack([x, np.sqrt(np.maximum(radius**2 - (x * x).sum(axis=1), 0))])
    sample_x = np.array([r.vector for r in rows]) if rows else np.zeros((1, 1))
    model = spark.sparkContext.broadcast(Curves(lift(sample_x), curves, seed))

    def keyed(batches):
        for batch in batches:
            for part in slices(batch, 1024):
                x = np.array(part.column("vector").to_pylist())
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                scaled = lambda x: np.column_stack([x * (radius / np.sqrt((x * x).sum(axis=1)))[:, None], np.zeros(len(x))])
                for kind, lifted_by, pick in ((0, lift, np.flatnonzero(~asks)), (1, scaled, np.flatnonzero(asks))):
                    if not len(pick):
                        continue
                    lifted = lifted_by(x[pick])
                    keys = model.value.keys(lifted)
                    for c in range(curves):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), c, np.int32)), pa.array(keys[:, c]), pa.array(np.full(len(pick), kind, np.int32)), part.column("vec_id").take(pa.array(pick)), part.column("vector").take(pa.array(pick))], names=["curve", "key", "kind", "vec_id", "vector"])

    equal = Window.partitionBy("vector").orderBy("vec_id")
    first = data.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= k + 1)
    both = first.select("vec_id", "vector", F.lit(False).alias("asks")).union(data.where(is_query).select("vec_id", "vector", F.lit(True)))
    points = both.mapInArrow(keyed, "curve int, key long, kind int, vec_id long, vector array<double>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("vec_id")
    ordered = points.withColumn("tie", F.xxhash64("curve", "vec_id")).repartitionByRange(parts, "curve", "key", "tie").sortWithinPartitions("curve", "key", "tie", "kind")

    def number(batches):
        """Position of each row among the partition's vectors of its curve."""
        pid, seen = TaskContext.get().partitionId(), np.zeros(curves, np.int64)
        for batch in batches:
            c, data_row = batch.column("curve").to_numpy(), batch.column("kind").to_numpy() == 0
            at = np.empty(len(c), np.int64)
            for v in np.unique(c):
                mine = c == v
                run = np.cumsum(data_row[mine]) + seen[v]
                at[mine], seen[v] = run - data_row[mine], run[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), pid, np.int32)), batch.column("curve"), batch.column("kind"), batch.column("vec_id"), batch.column("vector"), pa.array(at)], names=["pid", "curve", "kind", "vec_id", "vector", "at"])

    placed = materialise(ordered.select("curve", "kind", "vec_id", "vector").mapInArrow(number, "pid int, curve int, kind int, vec_id long, vector array<double>, at long"), "curves")
    counts = placed.where("kind = 0").groupBy("curve", "pid").count().orderBy("curve", "pid").collect()  # at most curves x partitions
    before, base, held = {}, {}, {(r.curve, r.pid): r["count"] for r in counts}
    for r in counts:
        base[r.curve, r.pid] = before.get(r.curve, 0)
        before[r.curve] = before.get(r.curve, 0) + r["count"]
    for c in range(curves):  # a partition with queries only
        done = 0
        for p in range(parts):
            base.setdefault((c, p), done)
            done = max(done, base[c, p] + held.get((c, p), 0))
    offsets = spark.createDataFrame([(c, p, b) for (c, p), b in base.items()], "curve int, pid int, base long")
    ranked = placed.join(F.broadcast(offsets), ["curve", "pid"]).withColumn("r", F.col("base") + F.col("at"))
    n = before.get(0, 0)  # candidates
    half, last = int(np.ceil(window * n)), max(0, (n - 1) // BLOCK)
    subs = max(1, int(np.ceil(top.q * min(1.0, (2 * half + BLOCK) / max(n, 1)) / QUERY_ROWS)))
    sub = F.pmod(F.col("tie"), F.lit(subs)).cast("int")
    block = lambda r: F.least(F.lit(last), F.greatest(F.lit(0), F.floor(r / BLOCK)))
    ask = ranked.where("kind = 1").withColumn("tie", tie).select("curve", F.explode(F.sequence(block(F.col("r") - half), block(F.col("r") + half))).alias("block"), sub.alias("sub"), "vec_id", "vector")
    have = ranked.where("kind = 0").select("curve", block(F.col("r")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(subs - 1))).alias("sub"), "vec_id", "vector", F.xxhash64("vector").alias("copy"))

    have, ask = have.toDF(*have.columns), ask.toDF(*ask.columns)  # columns of their own on either side

    def compare(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(rows):
            d, ids = matrix(rows["vector"]), rows["vec_id"].to_numpy()
            for at in range(0, len(asks), 256):
                own = asks["vec_id"].to_numpy()[at : at + 256]
                q = matrix(asks["vector"].iloc[at : at + 256])
                row, col, _ = best(q @ d.T, ids, own, k)
                out.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[col], "copy": rows["copy"].to_numpy()[col], "a": row + at, "b": col}))
        found = pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "vec_id", "copy", "a", "b")}).astype("int64")
        # Scores again, one product at a time in one order of summation: equal wherever a pair is met.
        if len(found):
            x = matrix(asks["vector"])[found["a"].to_numpy()]
            found["score"] = np.einsum("ij,ij->i", x, d[found["b"].to_numpy()])
        else:
            found["score"] = np.zeros(0)
        return found[["query_id", "vec_id", "copy", "score"]]

    met = ask.groupBy("curve", "block", "sub").cogroup(have.groupBy("curve", "block", "sub")).applyInPandas(compare, "query_id long, vec_id long, copy long, score double")
    met = met.groupBy("query_id", "vec_id", "copy").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
