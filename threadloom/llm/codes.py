"""Product codes of vectors: Lloyd rounds over cover trees.

Components become integers, floor(1024 * x), and vectors are cut into four
consecutive parts of (nearly) equal length, each with a codebook of its own.
Every Spark task builds cover trees over chunks of its own vectors, one per part
of the vector, and stores them: a chunk's distinct parts in farthest-first order
give nested nets, each point hangs below the nearest point of the net before, and
every node knows the sum and number of the parts below it and its covering
radius. A round walks the trees from the top. A node whose nearest entry stays
nearest for all that it covers, by the triangle inequality, hands its sum to that
entry; only the others descend, with the entries that may still win, and single
points are compared exactly (ties to the lower entry). Sums of tasks are added in
a second step; the codebooks, a fixed number of entries, come from the driver.

Rows without a sound vector (null, or with a null or non-finite component) go, and
so do vectors whose length is not the commonest one (of equally common ones the
smaller). Repeated rows count and are coded each; rows with a null id are coded
but never start an entry, and of an id with several vectors the least vector
starts one. Without any id, or with an empty table, there are no rows. With under
256 ids there are as many entries. Other columns are ignored, whatever their
names. Components beyond 2^18 in size raise: their distances exceed a long.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise
from .vectors import sound

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of one set of trees: building compares all pairs of a chunk once.
CHUNK = 2048
#: Largest size of a scaled component.
LARGEST = 1 << 28
#: Tasks that add up what the others found.
ADDERS = 16
#: Most labels whose sums are broadcast; beyond it they are joined by a shuffle.
BROADCAST_LABELS = 200_000


def bounds(dim: int) -> list[tuple[int, int]]:
    return [(dim * p // PARTS, dim * (p + 1) // PARTS) for p in range(PARTS)]


def narrow(a: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    return a.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as doubles where they hold them and else as integers."""
    most = max(abs(int(v)) for a in (x, y) if a.size for v in (a.min(), a.max())) if x.size and y.size else 0
    if 4 * most**2 * max(1, x.shape[1]) < 1 << 53:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    out = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        out += np.subtract.outer(x[:, k].astype(np.int64), y[:, k].astype(np.int64)) ** 2
    return out


class CoverTree:
    """Distinct integer points in farthest-first order, so that every net is a prefix: nets[i] is the size of the i-th.

    up[i] leads each node of net i + 1 to its node in net i; sums, counts and radii are those of all below a node of net i (of
    the last net the points themselves).
    """

    def __init__(self, points: np.ndarray, weight: np.ndarray):
        d2 = squares(points, points)
        order, reach, gap = [0], [0.0], d2[0].copy()
        for _ in range(len(points) - 1):
            k = int(gap.argmax())
            order.append(k)
            reach.append(float(gap[k]))
            np.minimum(gap, d2[k], out=gap)
        self.order = np.array(order)
        x, w, d2 = points[self.order], weight[self.order].astype(np.int64), d2[np.ix_(self.order, self.order)]
        # A point is in every net of a radius below its distance from the points before it; radii halve.
        level = np.zeros(len(x), np.int64)
        if len(x) > 1:
            level[1:] = np.floor(0.5 * np.log2(reach[1] / np.array(reach[1:]))).astype(np.int64) + 1
        self.nets = [int(n) for n in np.searchsorted(level, np.unique(level), side="right")]
        self.up, self.sums, self.counts, self.radii = [], [], [], []
        for below, n in zip(self.nets, self.nets[1:]):
            self.up.append(np.concatenate([np.arange(below), d2[below:n, :below].argmin(axis=1)]))
        sums, counts, over = w[:, None] * x.astype(np.int64), w, np.arange(len(x))
        for below, up in zip(self.nets[-2::-1], self.up[::-1]):
            over, deeper, many = up[over], sums, counts
            sums, counts, radii = np.zeros((below, x.shape[1]), np.int64), np.zeros(below, np.int64), np.zeros(below)
            np.add.at(sums, up, deeper)
            np.add.at(counts, up, many)
            np.maximum.at(radii, over, d2[over, np.arange(len(x))].astype(float))
            self.sums.insert(0, narrow(sums))
            self.counts.insert(0, narrow(counts))
            self.radii.insert(0, np.sqrt(radii))
        self.x, self.weight, self.up = narrow(x), narrow(w), [narrow(u) for u in self.up]

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each point in the order given to the tree, sums and counts by entry)."""
        sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        label = np.zeros(0, np.int64)
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        last = len(self.nets) - 1
        for i, n in enumerate(self.nets):
            # What a node of the net above has settled holds for all below it.
            label = np.full(n, -1) if i == 0 else label[self.up[i - 1]]
            d2 = squares(self.x[nodes], book)
            d2 = np.where(may, d2, np.inf) if d2.dtype == np.float64 else np.where(may, d2, np.iinfo(np.int64).max)
            first = d2.argmin(axis=1)
            far = np.sqrt(d2.astype(float))
            nearest = far[np.arange(len(nodes)), first]
            if i == last:
                sure, own, many = np.ones(len(nodes), bool), self.weight[:, None].astype(np.int64) * self.x, self.weight
            else:
                radius, own, many = self.radii[i][nodes], self.sums[i], self.counts[i]
                reach = nearest + 2 * radius + 1e-9 * (1 + nearest)
                left = far <= reach[:, None]
                left[np.arange(len(nodes)), first] = True
                sure = (left.sum(axis=1) == 1) | (self.counts[i][nodes] == self.weight[nodes])
            np.add.at(sums, first[sure], own[nodes[sure]])
            np.add.at(counts, first[sure], many[nodes[sure]])
            label[nodes[sure]] = first[sure]
            if sure.all():
                for up in self.up[i:]:
                    label = label[up]
                break
            at = np.full(n, -1)
            at[nodes[~sure]] = np.flatnonzero(~sure)
            above = at[self.up[i]]
            nodes = np.flatnonzero(above >= 0)
            may = left[above[nodes]]
        out = np.empty(len(label), np.int64)
        out[self.order] = label
        return out, sums, counts


def plant(x: np.ndarray) -> bytes:
    """The trees of a chunk's parts, each with the place of every row among its distinct parts."""
    trees = []
    for low, high in bounds(x.shape[1]):
        points, where, many = np.unique(x[:, low:high], axis=0, return_inverse=True, return_counts=True)
        trees.append((CoverTree(points, many), narrow(where.reshape(-1))))
    return pickle.dumps(trees, protocol=5)


def compress(df: DataFrame, label: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits per part), error, label_error (the errors of a label's rows together) and codebooks_sha256."""
    spark, kind = df.sparkSession, df.schema[label].dataType
    rows = sound(df.select("vec_id", F.col(label).alias("label"), "embedding"), "vec_id", "label")
    empty = spark.createDataFrame([], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    # A bounded number of ids, and of each its least vector.
    ids = [r.vec_id for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    if not ids:
        return empty
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    start = np.floor(np.array([r.vector for r in first]) * SCALE)
    dim = start.shape[1]
    if not dim:
        return empty

    label_type = to_arrow_type(kind)

    def build(batches):
        held: list[pa.RecordBatch] = []
        wide = pa.schema([("vec_id", pa.int64()), ("label", label_type), ("vector", pa.list_(pa.float64()))])

        def flush():
            t = pa.Table.from_batches(held, wide).combine_chunks()
            held.clear()
            value = np.floor(t.column("vector").combine_chunks().flatten().to_numpy() * SCALE)
            if np.abs(value).max(initial=0) > LARGEST:
                raise OverflowError("components beyond 2^18 in size have no code")
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks())
            return pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([plant(value.astype(np.int64).reshape(t.num_rows, dim))], pa.binary())], names=["vec_id", "label", "trees"])

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                if sum(b.num_rows for b in held) + part.num_rows > CHUNK:
                    yield flush()
                held.append(pa.RecordBatch.from_arrays([part.column(c).cast(wide.field(c).type) for c in wide.names], schema=wide))
        if held:
            yield flush()

    shape = T.StructType([T.StructField("vec_id", T.ArrayType(T.LongType())), T.StructField("label", T.ArrayType(kind)), T.StructField("trees", T.BinaryType())])
    trees = materialise(rows.mapInArrow(build, shape), "cover-trees")
    books = [start[:, low:high].astype(np.int64) for low, high in bounds(dim)]

    def shares(books):
        """Per task and part: the sums by entry, then the counts."""

        def run(batches):
            total: list | None = None
            for batch in batches:
                for blob in batch.column("trees"):
                    got = [tree.assign(book)[1:] for (tree, _), book in zip(pickle.loads(blob.as_py()), books)]
                    total = [(a + c, b + d) for (a, b), (c, d) in zip(total, got)] if total else got
            if total:
                values = [np.concatenate([s.reshape(-1), n]) for s, n in total]
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * PARTS), pa.array(range(PARTS), pa.int32()), pa.array(values, pa.list_(pa.int64()))], names=["task", "part", "values"])

        return run

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in zip(batch.column("part").to_pylist(), batch.column("values")):
                total[part] = total.get(part, 0) + values.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["part", "values"])

    for _ in range(ROUNDS):
        found = trees.select("trees").mapInArrow(shares(books), "task long, part int, values array<long>").repartition(ADDERS, "task").mapInArrow(added, "part int, values array<long>")
        values = [0] * PARTS
        for r in found.collect():  # at most ADDERS rows a part
            values[r.part] = values[r.part] + np.array(r["values"])
        new = []
        for book, v in zip(books, values):
            sums, counts = v[: book.size].reshape(book.shape), v[book.size :]
            new.append(np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book))
        books = new
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.reshape(-1)).encode()).hexdigest()

    def encode(batches):
        for batch in batches:
            for ids, labels, blob in zip(batch.column("vec_id"), batch.column("label"), batch.column("trees")):
                codes, error = [], 0
                for (tree, where), book in zip(pickle.loads(blob.as_py()), books):
                    entry, _, _ = tree.assign(book)
                    points = np.empty(tree.x.shape, np.int64)
                    points[tree.order] = tree.x
                    error = error + ((points - book[entry]) ** 2).sum(axis=1)[where]
                    codes.append(entry[where])
                code = [bytes(c).hex() for c in np.column_stack(codes).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(code), pa.array(error)], names=["vec_id", "label", "code", "error"])

    shape = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = materialise(trees.mapInArrow(encode, shape), "codes")
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"), "label-errors")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_LABELS else totals
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
