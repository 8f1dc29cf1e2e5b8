"""Density clusters (HDBSCAN) of any number of vectors, without a task that holds them all.

Vectors are scaled to length one, reduced to their principal axes by a Gram matrix
that tasks sum up, numbered by id and cut into blocks. A pair of blocks is a task
and finds the nearest neighbours of each point, whose `least`-th is its core
distance. The edges to near points, by mutual reachability, give a forest (Boruvka
rounds: every component takes its least edge), and a sample joins its parts to a
tree. An edge is missing in it only if it is less than the greatest on the path
between its ends; pairs of blocks in the order of the tree's leaves find these,
and compare only points whose near ones leave it open. Edges are told apart by
weight and ends, so the tree is one and the same whatever the blocks.

The tree's edges, sorted and numbered, give the dendrogram in runs of a bounded
number: a run's task merges what the runs before have left, and tells the rest
which component each end is in by now. Going back from the last run to the first,
every node learns its cluster: a split counts only where both sides have `least`
points. Clusters, at most two per `least` points, are chosen by excess of mass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.store import stored
from . import ordered

#: Most points of a block; a task compares two.
BLOCK = 1 << 14
#: Blocks on each side that a block is compared with by one query, for which it is copied so many times.
WAVE = 8
#: Edges of a run.
RUN = 1 << 18
#: Rows and columns whose distances are made at a time, so that they stay in a core's cache, and pairs of which differences are made at a time.
SLAB, TILE, CHUNK = 256, 1024, 1 << 15
#: Points that are compared with each other at first.
LEAF = 2048
#: Points whose edges join what the edges to near points leave apart.
SAMPLE = 4096
#: Near points of each that the first tree is made of.
NEAR = 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(n, -1)


def reduced(points: DataFrame, dim: int = 48) -> DataFrame:
    """points (g, embedding) as (g, x): scaled to length one, projected to `dim` principal axes where that is fewer, and scaled again."""
    n = points.count()
    width = points.select(F.size("embedding").alias("d")).first()
    d = width.d if width else 0
    axes = centre = None
    if d > dim and n > dim + 1:

        def gram(batches):
            total = np.zeros((d + 1, d))
            for b in batches:
                x = _unit(_rows(b.column("embedding"), b.num_rows))
                total[:d] += x.T @ x
                total[d] += x.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "v"])

        each = points.select("embedding").mapInArrow(gram, "k int, v array<double>").select("k", F.posexplode("v").alias("j", "v"))
        total = np.zeros((d + 1, d))
        for r in each.groupBy("k", "j").agg(F.sum("v").alias("v")).toLocalIterator():  # one number per pair of dimensions
            total[r.k, r.j] = r.v
        centre = total[d] / n
        _, vectors = np.linalg.eigh(total[:d] / n - np.outer(centre, centre))
        axes = vectors[:, ::-1][:, :dim]

    def project(batches):
        for b in batches:
            x = _unit(_rows(b.column("embedding"), b.num_rows))
            x = x if axes is None else _unit((x - centre) @ axes)
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(list(x), pa.list_(pa.float64()))], names=["g", "x"])

    return points.select("g", "embedding").mapInArrow(project, "g long, x array<double>")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def least_of(d: np.ndarray, k: int) -> np.ndarray:
    """The k least of each row, as a copy: a view would keep the whole slab."""
    return np.partition(d, k - 1, axis=1)[:, :k].copy() if d.shape[1] > k else d


def _close(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray | None = None):
    """(i, j, d) of the rows of x and y with d <= a[i] or d <= b[j], some at a time.

    A product in single precision, with its error allowed for, leaves out nearly all pairs; d is then made of differences, and so the same wherever a pair is met.
    """
    if not len(x) or not len(y):
        return
    # Rows with like distances stand together, so that the greatest product of a row tells whether any of a tile is near.
    b = np.full(len(y), -1.0) if b is None else b
    rows, columns = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
    x, y, a, b = x[rows], y[columns], a[rows], b[columns]
    p, q = (x * x).sum(axis=1), (y * y).sum(axis=1)
    slack = (x.shape[1] + 8) * 2.0**-23 * max(p.max(), q.max())
    left = np.column_stack([x, -p / 2, np.ones(len(x))]).astype(np.float32)
    right = np.column_stack([y, np.ones(len(y)), -q / 2]).astype(np.float32)
    low, high = (np.where(t < 0, np.inf, -t * t / 2 - slack).astype(np.float32) for t in (a, b))
    balls = [[(k, m[k : k + n].mean(axis=0)) for k in range(0, len(m), n)] for m, n in ((x, SLAB), (y, TILE))]
    balls = [[(k, c, _apart(m[k : k + n], c).max()) for k, c in of] for of, m, n in ((balls[0], x, SLAB), (balls[1], y, TILE))]
    for s, c, r in balls[0]:
        for t, e, f in balls[1]:
            if np.sqrt(((c - e) ** 2).sum()) - r - f > max(a[s], b[t : t + TILE][-1]) + 1e-6:
                continue  # all of these rows are farther from all of those
            score = left[s : s + SLAB] @ right[t : t + TILE].T
            some = np.flatnonzero(score.max(axis=1) >= np.minimum(low[s : s + SLAB], high[t : t + TILE].min()))
            if not len(some):
                continue
            score = score if len(some) == len(score) else score[some]
            hit = score >= low[s + some, None]
            if b[-1] >= 0:
                np.logical_or(hit, score >= high[None, t : t + TILE], out=hit)
            found = np.flatnonzero(hit)
            for z in range(0, len(found), CHUNK):
                i, j = np.divmod(found[z : z + CHUNK], score.shape[1])
                i, j = some[i] + s, j + t
                d = _apart(x[i], y[j])
                near = (d <= a[i]) | (d <= b[j])
                yield rows[i[near]], columns[j[near]], d[near]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _joined(parts: list[tuple], *types) -> list[np.ndarray]:
    return [np.concatenate([np.empty(0, t), *(p[k] for p in parts)]) for k, t in enumerate(types)]


def _blocks(rows: DataFrame, at: str, size: int, *columns: str) -> DataFrame:
    """A row per block of `size` places: the columns' values, in the order of places, as bytes."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by(at)
        held = [t.column(c).combine_chunks() for c in columns]
        held = [(c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False).tobytes() for c in held]
        return pa.Table.from_arrays([t.column("b")[:1].combine_chunks(), *(pa.array([c], pa.binary()) for c in held)], names=["b", *columns])

    own = rows.withColumn("b", F.floor(F.col(at) / size).cast("int")).select("b", at, *(c for c in columns if c != at))
    return own.groupBy("b").applyInArrow(pack, ", ".join(["b int", *(f"{c} binary" for c in columns)]))


def _over_pairs(blocks: DataFrame, pairs: list[tuple[int, int]], run, shape: str) -> DataFrame:
    """run over the one or two blocks of every pair (i, j), i <= j."""
    sides = [(i, k) for k, (i, j) in enumerate(pairs)] + [(j, k) for k, (i, j) in enumerate(pairs) if i != j]
    sides = blocks.sparkSession.createDataFrame(sides, "b int, p int")
    spread = blocks.repartition(min(len(pairs), 1 + max(j for _, j in pairs)), "b")
    return spread.join(F.broadcast(sides), "b").repartition(min(2 * len(pairs), 1024), "p").groupBy("p").applyInArrow(run, shape)


def _size(n: int) -> int:
    """Points of a block: few enough blocks that each is not copied often, and enough of them for all tasks."""
    return min(BLOCK, max(LEAF, -(-n // 12)))


def _apart_by(count: int, low: int, high: int) -> list[tuple[int, int]]:
    """The pairs of blocks, in a ring of `count`, that are at least `low` and less than `high` apart."""
    return [tuple(sorted((b, (b + o) % count))) for o in range(low, min(high, count // 2 + 1)) for b in range(count if 2 * o < count else o)]


def _best(r: np.ndarray, h: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k least d of each r, in order, and their ranks."""
    order = np.argsort(d)
    order = order[np.argsort(r[order].astype(np.uint16 if BLOCK <= 1 << 16 else np.int64), kind="stable")]
    r, h, d = r[order], h[order], d[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    rank = np.arange(len(r)) - np.repeat(first, np.diff(first, append=len(r)))
    keep = rank < k
    return r[keep], h[keep], d[keep], rank[keep]


def _bound(x: np.ndarray, k: int) -> np.ndarray:
    """Per row a distance within which at least k others lie."""
    if len(x) <= k:
        return np.full(len(x), np.inf)
    far = np.concatenate([np.partition(_distances(x[s : s + SLAB], x), k, axis=1)[:, k] for s in range(0, len(x), SLAB)])  # itself is among them
    return far * (1 + 1e-9) + 1e-6 * max(1.0, np.abs(x).max())  # the product's error


def _either(x: np.ndarray, y: np.ndarray, far: np.ndarray, back: np.ndarray) -> tuple[list, list]:
    """Of rows of x the rows of y within `far`, and of rows of y those of x within `back`, as (row, other, d)."""
    there, here = [], []
    for i, j, d in _close(x, y, far, back):
        for found, own, other, most in ((there, i, j, far), (here, j, i, back)):
            some = d <= most[own]
            found.append((own[some], other[some], d[some]))
    return there, here


def _within(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, h, d) of the k nearest other rows of each row: within leaves, then between halves of ever larger parts."""
    far, parts = np.empty(len(x)), []
    for a in range(0, len(x), LEAF):
        y = x[a : a + LEAF]
        far[a : a + LEAF] = _bound(y, k)
        parts += [(i[i != j] + a, j[i != j] + a, d[i != j]) for i, j, d in _close(y, y, far[a : a + LEAF])]
    span = LEAF
    while True:
        r, h, d, rank = _best(*_joined(parts, np.int64, np.int64, np.float64), k)
        if span >= len(x):
            return r, h, d
        far[r[rank == k - 1]] = d[rank == k - 1]
        parts = [(r, h, d)]
        for a in range(0, len(x), 2 * span):
            c, e = a + span, a + 2 * span
            there, here = _either(x[a:c], x[c:e], far[a:c], far[c:e])
            parts += [(i + a, j + c, d) for i, j, d in there] + [(j + c, i + a, d) for j, i, d in here]
        span *= 2


def near(points: DataFrame, n: int, k: int) -> DataFrame:
    """(g, h, d): of every point of (g, x) the k nearest others and their distances, nearest first.

    Pairs of blocks come in waves, each of at most twice as many blocks as a point has met before, so that few pairs come within the distance of
    the k nearest so far. Between waves a row per block is kept.
    """
    size = _size(n)
    count = -(-n // size)
    blocks = stored(_blocks(points, "g", size, "x"), "blocks")

    def rows(t: pa.Table, column: str, kind=np.float64) -> list[np.ndarray]:
        return [np.frombuffer(v.as_buffer(), kind) for v in t.column(column)]

    def of_pair(t: pa.Table) -> pa.Table:
        t = t.sort_by("b")
        b = t.column("b").to_pylist()
        x = [v.reshape(min(size, n - c * size), -1) for c, v in zip(b, rows(t, "x"))]
        lists = [[_within(x[0], k)]] if len(b) == 1 else _either(*x, *rows(t, "far"))
        sides = []
        for c, other, parts in zip(b, reversed(b), lists):
            r, h, d, _ = _best(*_joined(parts, np.int64, np.int64, np.float64), k)
            sides.append((c, r.tobytes(), (h + other * size).tobytes(), d.tobytes()))
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*sides), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["b", "r", "h", "d"])

    def merged(t: pa.Table) -> pa.Table:
        b = t.column("b")[0].as_py()
        r, h, d, rank = _best(*(np.concatenate(rows(t, c, kind)) for c, kind in (("r", np.int64), ("h", np.int64), ("d", np.float64))), k)
        far = np.full(min(size, n - b * size), np.inf)
        far[r[rank == k - 1]] = d[rank == k - 1]
        return pa.Table.from_arrays([pa.array([b], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (r, h, d, far))], names=["b", "r", "h", "d", "far"])

    shape = "b int, r binary, h binary, d binary"
    met = stored(_over_pairs(blocks, [(b, b) for b in range(count)], of_pair, shape).groupBy("b").applyInArrow(merged, shape + ", far binary"), "near")
    low = 1
    while low <= count // 2:
        high = min(2 * low, low + WAVE)
        found = stored(_over_pairs(blocks.join(met.select("b", "far"), "b"), _apart_by(count, low, high), of_pair, shape), "found")
        met = stored(found.union(met.drop("far")).groupBy("b").applyInArrow(merged, shape + ", far binary"), "near")
        low = high

    def lists(batches):
        for batch in batches:
            for b, r, h, d in zip(*(batch.column(c) for c in ("b", "r", "h", "d"))):
                r, h, d = np.frombuffer(r.as_buffer(), np.int64), np.frombuffer(h.as_buffer(), np.int64), np.frombuffer(d.as_buffer())
                cuts = np.searchsorted(r, np.arange(min(size, n - b.as_py() * size) + 1))
                for a in range(0, len(cuts) - 1, 4096):
                    c = cuts[a : a + 4097]
                    g = pa.array(np.arange(a, a + len(c) - 1) + b.as_py() * size)
                    offsets = pa.array((c - c[0]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([g, *(pa.ListArray.from_arrays(offsets, pa.array(v[c[0] : c[-1]])) for v in (h, d))], names=["g", "h", "d"])

    return met.select("b", "r", "h", "d").repartition(count, "b").mapInArrow(lists, "g long, h array<long>, d array<double>")


def core_of(nearest: DataFrame, n: int, least: int) -> DataFrame:
    """(g, core) of rows (g, d): the distance to the least-th nearest point, itself the first."""
    k = min(least, n) - 2
    return nearest.select("g", (F.get("d", F.lit(k)) if k >= 0 else F.lit(0.0)).alias("core"))


def core_distances(points: DataFrame, n: int, least: int) -> DataFrame:
    """(g, core): the distance to the least-th nearest point, itself the first."""
    return core_of(near(points, n, max(min(least, n) - 1, 1)), n, least)


def spanning_tree(x: np.ndarray, core: np.ndarray, left: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prim's algorithm over mutual reachability, by (weight, smaller end, larger end): ends, weights and the end that each edge adds, by row.

    With `left`, only edges between the first so many rows and the others count.
    """
    cuts = [(0, left), (left, len(x))] if left else [(0, len(x))]
    # Of each side the rows that are not in the tree yet, at the front; what leaves is overwritten by the last of them.
    at, rows = [np.arange(a, b) for a, b in cuts], [x[a:b].copy() for a, b in cuts]
    sq, own = [(r * r).sum(axis=1) for r in rows], [core[a:b].copy() for a, b in cuts]
    best, via, count = [np.full(b - a, np.inf) for a, b in cuts], [np.full(b - a, -1) for a, b in cuts], [b - a for a, b in cuts]

    def key(side: int, k: int) -> tuple[int, int]:
        return tuple(sorted((int(at[side][k]), int(via[side][k]))))

    out, side, k = [], 0, 0
    for _ in range(len(x)):
        now, v, s, c = int(at[side][k]), rows[side][k].copy(), sq[side][k], own[side][k]
        if out or via[side][k] >= 0:
            out.append((*key(side, k), best[side][k], now))
        last = count[side] = count[side] - 1
        for column in (at, rows, sq, own, best, via):
            column[side][k] = column[side][last]
        to = 1 - side if left else side
        n = count[to]
        d = rows[to][:n] @ v
        d *= -2
        d += sq[to][:n]
        d += s
        np.maximum(d, 0, out=d)
        np.sqrt(d, out=d)
        np.maximum(d, own[to][:n], out=d)
        np.maximum(d, c, out=d)
        some = np.flatnonzero(d <= best[to][:n])
        new, old = d[some], best[to][some]
        if not (closer := new < old).all():
            ends, before = at[to][some], via[to][some]
            low, high, low0, high0 = np.minimum(ends, now), np.maximum(ends, now), np.minimum(ends, before), np.maximum(ends, before)
            some = some[closer | (low < low0) | (low == low0) & (high < high0)]
        best[to][some], via[to][some] = d[some], now
        least = [(best[t][:m].min(), t) for t, m in enumerate(count) if m]
        if not least:
            break
        w = min(least)[0]
        ties = [(t, int(q)) for m, t in least if m == w for q in np.flatnonzero(best[t][: count[t]] == w)]
        side, k = ties[0] if len(ties) == 1 else min(ties, key=lambda q: key(*q))
    u, v, w, new = (np.array(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    return u.astype(np.int64), v.astype(np.int64), w, new.astype(np.int64)


def lightest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which edges are in the minimum spanning forest of these, by the order of (w, u, v)."""
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while k in up:
            if up[k] in up:
                up[k] = up[up[k]]
            k = up[k]
        return k

    inside = np.zeros(len(u), bool)
    order = np.lexsort((v, u, w))
    for k, a, b in zip(order.tolist(), u[order].tolist(), v[order].tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[a], inside[k] = b, True
    return inside


def tree_edges(points: DataFrame, n: int, nearest: DataFrame | None = None) -> DataFrame:
    """(u, v, w), u < v: the minimum spanning tree of points (g, x, core).

    The forest of the edges to near points (`nearest`, made here if it is not given), joined by edges to a sample, is a tree that differs little
    from it. Of all other edges only those count that are less than some edge on the path between their ends in that tree. In the order of its
    leaves that path's greatest edge is the greatest of those between neighbours, so that a pair of blocks finds them by comparing. Most points
    need no comparing: whatever is not near them is farther than the last that is, and that is farther than the path's greatest edge.
    """
    nearest = stored(near(points, n, min(n - 1, NEAR)), "nearest") if nearest is None else nearest
    ends = nearest.select("g", F.explode(F.arrays_zip("h", "d")).alias("e")).select("g", F.col("e.h").alias("h"), F.col("e.d").alias("d"))
    ends = ends.select(F.least("g", "h").alias("u"), F.greatest("g", "h").alias("v"), "d").groupBy("u", "v").agg(F.min("d").alias("d"))
    for end in "uv":
        ends = ends.join(points.select(F.col("g").alias(end), F.col("core").alias(f"core_{end}")), end)
    edges, moves = _rounds(_between(stored(ends.select("u", "v", F.greatest("d", "core_u", "core_v").alias("w")), "near-edges")))
    first = _linked(points, stored(edges, "forest"), moves, n)
    ranked = _ranked(first)
    beyond = nearest.select("g", F.when(F.size("d") < n - 1, F.element_at("d", -1)).otherwise(float("inf")).alias("beyond"))
    return boruvka(stored(first.union(_lighter(points.join(beyond, "g"), ranked, *dendrogram(ranked, n), n)), "candidates"))


def _linked(points: DataFrame, forest: DataFrame, moves: list[DataFrame], n: int) -> DataFrame:
    """The forest made a tree: every component takes its least edge to a point of a sample outside it, until there is one."""
    missing = n - 1 - forest.count()
    if not missing:
        return forest
    step = max(1, n // SAMPLE)
    sample = sorted(points.where(F.col("g") % step == 0).select("g", "x", "core").collect())  # fewer than twice SAMPLE
    y, far, ids = np.array([r.x for r in sample]), np.array([r.core for r in sample]), np.array([r.g for r in sample])
    label = points.select("g", F.col("g").alias("a"))
    while missing:
        label = stored(_moved(label, moves, "a"), "components")
        names = dict(label.where(F.col("g") % step == 0).collect())
        of = np.array([names[g] for g in ids.tolist()])

        def least(batches):
            for batch in batches:
                x, core, g, a = _rows(batch.column("x"), batch.num_rows), *(batch.column(c).to_numpy() for c in ("core", "g", "a"))
                for s in range(0, len(x), SLAB):
                    z = slice(s, s + SLAB)
                    w = np.maximum(np.maximum(_distances(x[z], y), core[z, None]), far)
                    w[a[z, None] == of] = np.inf
                    j, some = w.argmin(axis=1), np.isfinite(w.min(axis=1))
                    j, at = j[some], np.flatnonzero(some) + s
                    w = np.maximum(np.maximum(_apart(x[at], y[j]), core[at]), far[j])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[at], of[j], np.minimum(g[at], ids[j]), np.maximum(g[at], ids[j]), w)], names=["a", "b", "u", "v", "w"])

        found = points.select("g", "x", "core").join(label, "g").mapInArrow(least, "a long, b long, u long, v long, w double")
        best = found.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.struct("m.w", "m.u", "m.v").alias("e"))
        links, moves = _rounds(stored(best, "links"))
        links = stored(links, "links")
        missing -= links.count()
        forest = forest.union(links)
    return stored(forest, "tree")


def _leaves(tree: DataFrame, runs: int, n: int) -> DataFrame:
    """(at, g, k) of a dendrogram: its leaves by place, and the number of the edge that joins each to the one before; the first has none."""
    open_nodes, parts = tree.sparkSession.createDataFrame([(2 * n - 2, 0)], "node long, at long"), []

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ascending=False)
        known = set(rows["node"].tolist())
        place = {k: int(p) for k, p in zip(rows["node"].tolist(), rows["at"].tolist()) if p == p}
        out = []
        for node, left, right, nl, nr in zip(*(rows[c].tolist() for c in ("node", "left", "right", "nl", "nr"))):
            p = place.pop(node)
            out.append(("k", node - n, p + max(nl, nr)))
            for side, q in ((left, p), (right, p + nl)) if nl >= nr else ((right, p), (left, p + nr)):  # the larger first
                if side in known:
                    place[side] = q
                else:
                    out.append(("g" if side < n else "s", side, q))
        return pd.DataFrame(out, columns=["kind", "node", "at"])

    for k in reversed(range(runs)):
        own = tree.where((F.col("node") >= n + k * RUN) & (F.col("node") < n + (k + 1) * RUN)).join(open_nodes, "node", "left")
        done = stored(_only(own, down, "kind string, node long, at long"), "places")
        parts.append(done)
        open_nodes = stored(open_nodes.where(F.col("node") < n + k * RUN).union(done.where("kind = 's'").select("node", "at")), "open") if k else None
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.where("kind = 'g'").select("at", F.col("node").alias("g")).join(whole.where("kind = 'k'").select("at", F.col("node").alias("k")), "at", "left")


def _lighter(points: DataFrame, ranked: DataFrame, tree: DataFrame, runs: int, n: int) -> DataFrame:
    """(u, v, w) outside a spanning tree (its edges by rank, its dendrogram) that are less than the greatest edge of the path between their ends.

    All points nearer to a point than `beyond` are in the tree's edges or needless for it. Of the edges that a pair of blocks finds, only those of
    their own minimum spanning forest are made.
    """
    size = _size(n)
    edges = ranked.select(F.col("g").alias("k"), "u", "v", "w")
    placed = _leaves(tree, runs, n).join(points.select("g", "x", "core", "beyond"), "g").join(edges, "k", "left")
    placed = placed.select("at", "g", "x", "core", "beyond", F.coalesce("k", F.lit(-1)).alias("k"), *(F.coalesce(c, F.lit(-1)).alias(c) for c in "uv"), F.coalesce("w", F.lit(-1.0)).alias("w"))
    kinds = {"x": np.float64, "core": np.float64, "beyond": np.float64, "w": np.float64, "g": np.int64, "k": np.int64, "u": np.int64, "v": np.int64}
    placed = stored(placed, "placed")
    blocks = stored(_blocks(placed, "at", size, *kinds), "blocks")
    count = -(-n // size)
    tops = placed.groupBy(F.floor(F.col("at") / size).alias("b")).agg(F.max(F.struct("k", "w", "u", "v")).alias("m")).orderBy("b").select("m.*").collect()  # a row per block
    tops = {c: np.array([r[c] for r in tops], kinds[c]) for c in "kwuv"}

    def of_pair(t: pa.Table) -> pa.Table:
        t = t.sort_by("b")
        b = t.column("b").to_pylist()
        held = [{c: np.frombuffer(t.column(c)[s].as_buffer(), kind) for c, kind in kinds.items()} for s in range(len(b))]
        for h in held:
            h["x"] = h["x"].reshape(len(h["g"]), -1)
        between = slice(b[0] + 1, b[-1])
        known = {c: np.concatenate([*(h[c] for h in held), tops[c][between], np.array([-1], kinds[c])]) for c in "kwuv"}
        order = np.argsort(known["k"], kind="stable")
        known = {c: v[order] for c, v in known.items()}
        kept: list[tuple] = []

        def edge(k: np.ndarray) -> list[np.ndarray]:
            at = np.searchsorted(known["k"], k)
            return [known[c][at] for c in "wuv"]

        def keep(i, j, d, left, right, k):
            w = np.maximum(np.maximum(d, left["core"][i]), right["core"][j])
            u, v = np.minimum(left["g"][i], right["g"][j]), np.maximum(left["g"][i], right["g"][j])
            top, low, high = edge(k)
            some = (w < top) | (w == top) & ((u < low) | (u == low) & (v < high))
            if some.any():
                kept.append((u[some], v[some], w[some]))
            if sum(len(c[0]) for c in kept) > RUN:
                lighten()

        def lighten():
            u, v, w = _joined(kept, np.int64, np.int64, np.float64)
            inside = lightest(u, v, w)
            kept[:] = [(u[inside], v[inside], w[inside])]

        def sides(left, right, over):
            """Pairs of a row of `left` and one of `right`, which comes later; `over` is the greatest number of an edge between."""
            a = np.maximum(np.maximum.accumulate(np.append(left["k"][1:], -1)[::-1])[::-1], over)
            z = np.maximum.accumulate(right["k"])
            wa, wz = edge(a)[0], edge(z)[0]
            p, q = (np.flatnonzero(h["beyond"] <= np.maximum(w, most)) for h, w, most in ((left, wa, wz[-1]), (right, wz, wa[0])))
            for i, j, d in _close(left["x"][p], right["x"][q], wa[p], wz[q]):
                keep(p[i], q[j], d, left, right, np.maximum(a[p[i]], z[q[j]]))

        if len(b) == 2:
            sides(*held, tops["k"][between].max(initial=-1))
        else:
            part = lambda low, high: {c: v[low:high] for c, v in held[0].items()}
            todo = [(0, len(held[0]["g"]))]
            while todo:
                low, high = todo.pop()
                if high - low > 32:
                    mid = (low + high) // 2
                    sides(part(low, mid), part(mid, high), -1)
                    todo += [(low, mid), (mid, high)]
                elif high - low > 1:
                    own = part(low, high)
                    i, j = np.triu_indices(high - low, 1)
                    path = np.maximum.accumulate(np.where(np.arange(high - low)[:, None] < np.arange(high - low), own["k"], -1), axis=1)
                    keep(i, j, _apart(own["x"][i], own["x"][j]), own, own, path[i, j])
        lighten()
        return pa.Table.from_arrays([pa.array(c) for c in kept[0]], names=["u", "v", "w"])

    whole = None
    for low in range(0, count // 2 + 1, WAVE):
        found = stored(_over_pairs(blocks, _apart_by(count, low, low + WAVE), of_pair, "u long, v long, w double"), "lighter")
        whole = found if whole is None else whole.union(found)
    return whole


def _between(edges: DataFrame) -> DataFrame:
    """Edges (u, v, w) as links (a, b, e) of components, each point its own."""
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e"))


def _moved(rows: DataFrame, moves: list[DataFrame], *ends: str) -> DataFrame:
    """Rows with the component that each end's component has become part of."""
    for up in moves:
        for end in ends:
            rows = rows.join(up.select(F.col("a").alias(end), F.col("up").alias("__to")), end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    return rows


def boruvka(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of (u, v, w), by the order of (w, u, v)."""
    return _rounds(_between(edges))[0]


def _rounds(now: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The edges (u, v, w) of the minimum spanning forest of links (a, b, e) between components, and, by round, which component (a) went into which (up).

    In a round every component takes its least link. What is left, once it is no more than a run, goes to one task.
    """
    parts, moves = [], []

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        ends, at = np.unique(np.concatenate([rows["a"], rows["b"]]), return_inverse=True)
        order = np.lexsort((rows["v"], rows["u"], rows["w"]))
        a, b = at[: len(rows)], at[len(rows) :]
        up = list(range(len(ends)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        inside = []
        for k, p, q in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                inside.append(k)
        found = rows.iloc[inside][["u", "v", "w"]].assign(a=-1, up=-1)
        return pd.concat([found, pd.DataFrame({"u": -1, "v": -1, "w": 0.0, "a": ends, "up": ends[[root(k) for k in range(len(ends))]]})])

    while (left := now.count()) > RUN:
        both = now.union(now.select("b", "a", "e"))
        least = stored(both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("up"), "m.e"), "least-edges")
        parts.append(least.select("e").distinct().select("e.u", "e.v", "e.w"))
        # Least edges form trees with one edge taken from both sides: there the smaller component is the root.
        back = least.select(F.col("a").alias("up"), F.col("up").alias("again"))
        up = stored(least.join(back, "up").select("a", F.when((F.col("again") == F.col("a")) & (F.col("a") < F.col("up")), F.col("a")).otherwise(F.col("up")).alias("up")), "up")
        while True:
            top = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            jumped = stored(up.join(top, "up").select("a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            up = jumped.select("a", "up")
            if jumped.where("moved").isEmpty():
                break
        moves.append(up)
        ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        now = stored(_moved(now, [up], "a", "b").where("a <> b").select(*ends, "e").groupBy("a", "b").agg(F.min("e").alias("e")), "between")
    if left:
        done = stored(_only(now.select("a", "b", "e.u", "e.v", "e.w"), last, "u long, v long, w double, a long, up long"), "last-edges")
        parts.append(done.where("u >= 0").select("u", "v", "w"))
        moves.append(done.where("u < 0").select("a", "up"))
    out = parts[0] if parts else now.select("e.u", "e.v", "e.w")
    for p in parts[1:]:
        out = out.union(p)
    return out, moves


def _only(rows: DataFrame, run, shape: str) -> DataFrame:
    """run over the rows of one run of edges: a bounded number, in one task."""
    return rows.withColumn("run", F.lit(0)).groupBy("run").applyInPandas(run, shape)


def _ranked(edges: DataFrame) -> DataFrame:
    return ordered.numbered(edges, "w", "u", "v")


def dendrogram(numbered: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Of a tree's edges by rank: (node, left, right, height, size, nl, nr) of every merge, nodes from n in the order of heights, and the number of runs.
    Leaves are 0 to n - 1."""
    runs = -(-(n - 1) // RUN)
    rest = numbered.select("g", "w", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"))
    merged = None

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g")
        up: dict[int, int] = {}
        size = dict(zip(rows["a"].tolist(), rows["na"].tolist())) | dict(zip(rows["b"].tolist(), rows["nb"].tolist()))

        def root(k: int) -> int:
            path = []
            while k in up:
                path.append(k)
                k = up[k]
            for p in path:
                up[p] = k
            return k

        out = []
        for g, w, a, b in zip(rows["g"].tolist(), rows["w"].tolist(), rows["a"].tolist(), rows["b"].tolist()):
            a, b = root(a), root(b)
            up[a] = up[b] = n + g
            size[n + g] = size[a] + size[b]
            out.append((n + g, a, b, w, size[n + g], size[a], size[b]))
        ends = [(k, top, 0.0, size[top]) for k in {*rows["a"], *rows["b"]} for top in (root(k),)]
        made = pd.DataFrame(out, columns=["node", "left", "right", "height", "size", "nl", "nr"])
        moved = pd.DataFrame(ends, columns=["node", "left", "height", "size"]).assign(right=-1, nl=0, nr=0)
        return pd.concat([made, moved])[["node", "left", "right", "height", "size", "nl", "nr"]]

    shape = "node long, left long, right long, height double, size long, nl long, nr long"
    for k in range(runs):
        done = stored(_only(rest.where((F.col("g") >= k * RUN) & (F.col("g") < (k + 1) * RUN)), merge, shape), "merges")
        own = done.where("right >= 0")
        merged = own if merged is None else merged.union(own)
        if k < runs - 1:
            rest = rest.where(F.col("g") >= (k + 1) * RUN)
            for end in "ab":
                moved = done.where("right < 0").select(F.col("node").alias(end), F.col("left").alias("__to"), F.col("size").alias("__n"))
                rest = rest.join(moved, end, "left").withColumns({f"n{end}": F.coalesce("__n", f"n{end}"), end: F.coalesce("__to", end)}).drop("__to", "__n")
            rest = stored(rest, "rest")
    return merged, runs


def condensed(tree: DataFrame, runs: int, n: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Of a dendrogram: (g, cluster, lam), where each leaf falls out of which cluster, and (cluster, parent, birth, death, size). Clusters are named by
    the dendrogram's node that they begin with; the root is the first."""
    root = 2 * n - 2
    start = tree.sparkSession.createDataFrame([(root, root, None)], "node long, cluster long, lam double")

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ascending=False)
        cluster = {k: (c, lam) for k, c, lam in zip(rows["node"].tolist(), rows["cluster"].tolist(), rows["lam"].tolist()) if c == c and c is not None}
        known, out = {*rows["node"].tolist()}, []
        for node, left, right, height, nl, nr in zip(*(rows[c].tolist() for c in ("node", "left", "right", "height", "nl", "nr"))):
            c, lam = cluster.pop(node)
            here = 1 / height if height > 0 else np.inf
            sides = ((left, nl, nr), (right, nr, nl))
            for side, size, other in sides:
                if lam == lam and lam is not None:  # all below has fallen out already
                    state = (c, lam)
                elif size < least:
                    state = (c, here)
                elif other >= least:
                    out.append(("c", side, c, here, size))
                    state = (side, None)
                else:
                    state = (c, None)
                if side < n:
                    out.append(("p", side, state[0], here if state[1] is None else state[1], 1))
                elif side in known:
                    cluster[side] = state
                else:
                    out.append(("s", side, state[0], state[1], 1))
        return pd.DataFrame(out, columns=["kind", "node", "cluster", "lam", "size"])

    open_nodes, parts = start, []
    for k in reversed(range(runs)):
        own = tree.where((F.col("node") >= n + k * RUN) & (F.col("node") < n + (k + 1) * RUN)).join(open_nodes, "node", "left")
        done = stored(_only(own, down, "kind string, node long, cluster long, lam double, size long"), "clusters")
        parts.append(done)
        below = done.where("kind = 's'").select("node", "cluster", "lam")
        open_nodes = stored(open_nodes.where(F.col("node") < n + k * RUN).union(below), "open") if k else None
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    leaves = whole.where("kind = 'p'").select(F.col("node").alias("g"), "cluster", "lam")
    return leaves, whole.where("kind = 'c'").select(F.col("node").alias("cluster"), F.col("cluster").alias("parent"), F.col("lam").alias("birth"), "size")


def chosen(leaves: DataFrame, clusters: DataFrame, n: int) -> dict[int, int]:
    """Label of each cluster by excess of mass: those chosen, by size, and all within them. The root is none."""
    root = 2 * n - 2
    finite = F.max(F.when(F.col("lam") < float("inf"), F.col("lam"))).alias("m")
    top = max(leaves.agg(finite).first().m or 1.0, 1.0)
    sums = {r.cluster: (r.s, r.c) for r in leaves.groupBy("cluster").agg(F.sum(F.least("lam", F.lit(top))).alias("s"), F.count("*").alias("c")).collect()}  # a row per cluster
    parent, birth, size, death = {root: None}, {root: 0.0}, {root: n}, {}
    for r in clusters.collect():
        parent[r.cluster], birth[r.cluster], size[r.cluster], death[r.parent] = r.parent, r.birth, r.size, r.birth
    kids: dict[int, list[int]] = {c: [] for c in parent}
    for c, p in parent.items():
        if p is not None:
            kids[p].append(c)
    value, own = {}, set()
    for c in sorted(parent):  # children have smaller numbers
        s, points = sums.get(c, (0.0, 0))
        weight = s - points * min(birth[c], top) + sum(size[k] for k in kids[c]) * (min(death.get(c, 0.0), top) - min(birth[c], top))
        below = sum(value[k] for k in kids[c])
        value[c] = max(weight, below) if c != root else below
        if c != root and (not kids[c] or weight >= below):
            own.add(c)
    label: dict[int, int] = {}
    numbers: dict[int, int] = {}
    for c in sorted(parent, reverse=True):
        up = label.get(parent[c], -1) if parent[c] is not None else -1
        if up < 0 and c in own:
            up = numbers[c] = len(numbers)
        label[c] = up
    order = {numbers[c]: k for k, c in enumerate(sorted(numbers, key=lambda c: (-size[c], c)))}
    return {c: order.get(v, -1) for c, v in label.items()}


def _whole_tree(held: DataFrame, points: DataFrame, n: int, least: int) -> DataFrame:
    """(u, v, w): the spanning tree of mutual reachability of points (g, x).

    Of `least` or more equal rows of `held` the first stands for all, as every point near it has `least` points near it; the others hang on it by edges of length 0.
    """
    copies = held.groupBy("embedding").agg(F.min("g").alias("first"), F.count("*").alias("n")).where(F.col("n") >= max(least, 2)).select("embedding", "first")
    copies = stored(copies, "copies")
    if several := copies.count():
        copies = F.broadcast(copies) if several <= 20_000 else copies
        copies = stored(held.select("g", "embedding").join(copies, "embedding").select("g", "first"), "copies")
        kept = points.join(copies.where("g <> first").select("g"), "g", "left_anti").withColumnRenamed("g", "own")
        points = ordered.numbered(kept, "own")
        every, n = n, points.count()
    if n > 1:
        nearest = stored(near(points, n, min(n - 1, max(least - 1, NEAR))), "nearest")
        cores = core_of(nearest, n, least)
        if several:
            heavy = points.join(copies.where("g = first").select(F.col("g").alias("own")), "own").select(F.col("g").alias("h"))
            reach = nearest.select("g", F.explode(F.arrays_zip("h", "d")).alias("e")).select("g", "e.h", "e.d").join(heavy, "h").groupBy("g").agg(F.min("d").alias("d"))
            reach = reach.union(heavy.select("h", F.lit(0.0))).groupBy("g").agg(F.min("d").alias("d"))
            cores = cores.join(reach, "g", "left").select("g", F.least("core", "d").alias("core"))
        edges = tree_edges(stored(points.join(cores, "g"), "cores"), n, nearest)
    if not several:
        return edges
    equal = copies.where("g <> first").select(F.col("first").alias("u"), F.col("g").alias("v"), F.lit(0.0).alias("w"))
    if every - equal.count() == 1:
        return equal
    for end in "uv":
        edges = edges.join(points.select(F.col("g").alias(end), F.col("own").alias("__to")), end).withColumn(end, F.col("__to")).drop("__to")
    return edges.select("u", "v", "w").union(equal)


def clusters(records: DataFrame, least: int = 5, dim: int = 48) -> DataFrame:
    """(id, label, to_centre) of all records (id, embedding): noise is -1 and has no distance. Records without an embedding are noise."""
    spark = records.sparkSession
    rows = records.select("id", "embedding")
    held = ordered.numbered(rows.where("id is not null and size(embedding) > 0"), "id")
    points = stored(reduced(held, dim), "reduced")
    n = points.count()
    none = rows.select("id", F.lit(-1).alias("label"), F.lit(None).cast("double").alias("to_centre"))
    if n < max(2, least):
        return none
    tree, runs = dendrogram(_ranked(stored(_whole_tree(held, points, n, least), "edges")), n)
    leaves, parts = condensed(tree, runs, n, least)
    names = chosen(leaves, parts, n)
    names = spark.createDataFrame([*names.items()], "cluster long, label int")
    labelled = stored(points.select("g", "x").join(leaves.join(ordered.small(names), "cluster").select("g", "label"), "g"), "labelled")

    def means(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, label = _rows(b.column("x"), b.num_rows), b.column("label").to_numpy()
            for c in np.unique(label):
                total[int(c)] = total.get(int(c), 0) + x[label == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["label", "s"])

    sums = labelled.where("label >= 0").select("label", "x").mapInArrow(means, "label int, s array<double>").select("label", F.posexplode("s").alias("k", "v"))
    sums = sums.groupBy("label", "k").agg(F.sum("v").alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("s"))
    norm = F.greatest(F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, v: t + v * v)), F.lit(1e-300))
    centres = ordered.small(stored(sums.select("label", F.transform("s", lambda v: v / norm).alias("centre")), "centres"))
    far = F.sqrt(F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    found = labelled.join(centres, "label", "left").select("g", "label", far.alias("to_centre"))
    found = held.select("g", "id").join(found, "g").select("id", "label", "to_centre")
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), "to_centre")
