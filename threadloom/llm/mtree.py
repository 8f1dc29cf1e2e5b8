"""Exact top-k by inner product: best-first search of M-trees.

Vectors of integers are lifted onto a sphere, so that the largest inner product
is the smallest Euclidean distance, a metric. Pivots, whose number grows with
the table up to a bound, split it into regions; a region beyond `region_rows` is
split evenly by a hash. Each part is an M-tree, built in a task for every 4,096
queries that ask for the part: paged nodes, routing objects with covering radii and
with the distance to their parent's routing object. A query first searches the
region of its nearest pivot. Its k-th score then bounds all other regions: only
those whose covering radius reaches it are searched. Within a tree, nodes come
in the order of their least possible distance; stored parent distances exclude
entries by the triangle inequality before any distance is computed. Scores are
integers and exact up to 2**53; the distances that only exclude have a margin.

Null ids and unsound vectors take no part (see vectors.usable); equal rows count
once, ties go to the smaller id, an empty table gives no rows, and other columns
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise
from .vectors import matrix, usable

PAGE, FANOUT, QUERY_ROWS = 256, 16, 4096
#: Pivots: one per so many rows, at least the first and at most the second number, and at most so many numbers in all, which the driver and every task hold.
PIVOT_ROWS, PIVOTS, PIVOT_NUMBERS = 2048, (32, 16384), 1 << 22
MARGIN = 1e-6


class Node:
    __slots__ = ("pivot", "radius", "to_parent", "children", "points", "ids", "lift", "child_pivots", "child_radii", "child_to_parent")


def distances(points: np.ndarray, lift: np.ndarray, pivot: np.ndarray, pivot_lift: float) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(axis=1) + (lift - pivot_lift) ** 2)


def build(points: np.ndarray, lift: np.ndarray, ids: np.ndarray, pivot: tuple[np.ndarray, float], rng: np.random.Generator) -> Node:
    """A node over the points, with the pivot as its routing object."""
    node = Node()
    node.pivot, d = pivot, distances(points, lift, *pivot)
    node.radius, node.to_parent, node.children = float(d.max(initial=0.0)), 0.0, None
    if len(points) <= PAGE:
        node.points, node.lift, node.ids, node.child_to_parent = points, lift, ids, d
        return node
    chosen = rng.choice(len(points), FANOUT, replace=False)
    sq = (points**2).sum(axis=1) + lift**2
    cross = points @ points[chosen].T + np.outer(lift, lift[chosen])
    owner = np.argmin(sq[chosen][None, :] - 2 * cross, axis=1)
    if np.bincount(owner, minlength=FANOUT).max() > 0.9 * len(points):  # mostly equal points: split evenly
        owner = np.arange(len(points)) * FANOUT // len(points)
    node.children = []
    for c in np.unique(owner):
        mine = owner == c
        child = build(points[mine], lift[mine], ids[mine], (points[chosen[c]], float(lift[chosen[c]])), rng)
        child.to_parent = float(np.sqrt(((child.pivot[0] - pivot[0]) ** 2).sum() + (child.pivot[1] - pivot[1]) ** 2))
        node.children.append(child)
    node.child_pivots = np.stack([np.append(*c.pivot) for c in node.children])
    node.child_radii = np.array([c.radius for c in node.children])
    node.child_to_parent = np.array([c.to_parent for c in node.children])
    return node


def search(root: Node, q: np.ndarray, q_lift: float, reach2: float, own: int, k: int, least: float) -> list[tuple[float, int]]:
    """The k best (score, id) of the tree that score `least` or more; reach2 - 2 * score is a squared distance."""
    found: list[tuple[float, int]] = []  # heap of (score, -id)
    q_full = np.append(q, q_lift)

    def bound() -> float:
        s = max(least, found[0][0]) if len(found) == k else least
        return np.inf if s == -np.inf else np.sqrt(max(0.0, reach2 - 2 * s)) * (1 + MARGIN) + MARGIN

    d0 = float(np.sqrt(((q - root.pivot[0]) ** 2).sum() + (q_lift - root.pivot[1]) ** 2))
    queue, tick = [(max(0.0, d0 - root.radius), 0, root, d0)], 0
    while queue:
        low, _, node, d = heapq.heappop(queue)
        limit = bound()
        if low > limit:
            break
        if node.children is None:
            near = np.abs(d - node.child_to_parent) <= limit
            points, ids = (node.points, node.ids) if near.all() else (node.points[near], node.ids[near])
            scores = points @ q
            hits = np.flatnonzero(scores >= (max(least, found[0][0]) if len(found) == k else least))
            for s, i in zip(scores[hits].tolist(), ids[hits].tolist()):
                if i != own and (len(found) < k or (s, -i) > found[0]):
                    (heapq.heapreplace if len(found) == k else heapq.heappush)(found, (s, -i))
            continue
        near = np.flatnonzero(np.abs(d - node.child_to_parent) - node.child_radii <= limit)
        to = np.sqrt(((node.child_pivots[near] - q_full) ** 2).sum(axis=1))
        lows = np.maximum(0.0, to - node.child_radii[near])
        for c, t, lo in zip(near.tolist(), to.tolist(), lows.tolist()):
            if lo <= limit:
                tick += 1
                heapq.heappush(queue, (lo, tick, node.children[c], t))
    return [(s, -i) for s, i in sorted(found, key=lambda x: (-x[0], -x[1]))]


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, pivots: int | None = None, region_rows: int = 4096, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of floor(scale * x); is_query is a condition on vec_id."""
    spark = df.sparkSession
    data = usable(df, zero=True).select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector"))
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    top = data.agg(F.max(norm2).alias("m"), F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    m2 = float(top.m or 0.0)
    if pivots is None:
        pivots = max(PIVOTS[0], min(PIVOTS[1], top.n // PIVOT_ROWS, PIVOT_NUMBERS // max(1, top.dim or 1)))
    picked = data.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(pivots).collect()  # bounded
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = np.array([r.vector for r in picked])
    centres = np.column_stack([points, np.sqrt(np.maximum(m2 - (points**2).sum(axis=1), 0))])

    def to_centres(x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        full = np.column_stack([x, lift])
        return np.sqrt(np.maximum((full**2).sum(axis=1)[:, None] - 2 * full @ centres.T + (centres**2).sum(axis=1)[None, :], 0))

    lifted = lambda x: np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))

    def parts_of(batches):
        """The batches in parts whose distances to all pivots are PIVOT_NUMBERS at most."""
        step = max(1, PIVOT_NUMBERS // len(centres))
        for b in batches:
            for at in range(0, len(b), step):
                yield b.iloc[at : at + step]

    def assign(batches):
        for b in parts_of(batches):
            x = matrix(b["vector"])
            if len(x):
                d = to_centres(x, lifted(x))
                near = d.argmin(axis=1)
                yield pd.DataFrame({"vec_id": b["vec_id"], "vector": b["vector"], "region": near, "d": d[np.arange(len(x)), near]})

    placed = materialise(data.mapInPandas(assign, "vec_id long, vector array<double>, region int, d double"), "regions")
    sizes = {r.region: (r.n, r.radius) for r in placed.groupBy("region").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()}  # a row per pivot
    parts, radii = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
    for r, (n, radius) in sizes.items():
        parts[r], radii[r] = -(-n // region_rows), radius
    n_parts = spark.createDataFrame([(r, int(parts[r])) for r in sizes], "region int, parts int")  # at most a row per pivot
    cells = placed.join(F.broadcast(n_parts), "region").select("region", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), "vec_id", "vector")

    def compare(key, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            x = matrix(rows["vector"])
            r = int(rows["region"].iloc[0])
            root = build(x, lifted(x), rows["vec_id"].to_numpy(), (points[r], float(centres[r, -1])), np.random.default_rng(seed))
            for i, q, least in zip(asks["query_id"].tolist(), matrix(asks["vector"]), asks["least"].tolist()):
                out += [(i, v, int(s)) for s, v in search(root, q, 0.0, float(q @ q) + m2, i, k, least)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def routed(batches, home: bool):
        """Regions that a query must search: first its home; then those whose covering radius its k-th score leaves in reach."""
        for b in parts_of(batches):
            x = matrix(b["vector"])
            if not len(x):
                continue
            to, home_of = to_centres(x, np.zeros(len(x))), to_centres(x, lifted(x)).argmin(axis=1)
            lists = []
            for i in range(len(x)):
                if home:
                    regions = [int(home_of[i])]
                else:
                    least = float(b["least"].iloc[i])
                    limit = np.inf if least == -np.inf else np.sqrt(max(0.0, float(x[i] @ x[i]) + m2 - 2 * least)) * (1 + MARGIN) + MARGIN
                    regions = [r for r in np.flatnonzero(to[i] - radii <= limit).tolist() if r != int(home_of[i])]
                lists.append([(r, p) for r in regions for p in range(int(parts[r]))])
            yield pd.DataFrame({"query_id": b["query_id"], "vector": b["vector"], "least": b["least"], "at": [[{"region": r, "part": p} for r, p in own] for own in lists]})

    shape = "query_id long, vector array<double>, least double, at array<struct<region:int,part:int>>"

    def run(asks: DataFrame, home: bool) -> DataFrame:
        sent = asks.mapInPandas(lambda b: routed(b, home), shape).select("query_id", "vector", "least", F.explode("at").alias("at"))
        sent = sent.select("query_id", "vector", "least", "at.region", "at.part")
        # Only parts that are asked for are sent on, and again for every QUERY_ROWS of the queries that ask for them.
        asked = materialise(sent.groupBy("region", "part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("subs")), "asked")
        rows = cells.join(asked, ["region", "part"]).select("region", "part", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "vec_id", "vector")
        sent = sent.join(asked, ["region", "part"]).select("region", "part", F.pmod(F.xxhash64("query_id"), "subs").cast("int").alias("sub"), "query_id", "vector", "least")
        keys = ["region", "part", "sub"]
        return rows.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score long")

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    asks = data.where(is_query).select(F.col("vec_id").alias("query_id"), "vector", F.lit(float("-inf")).alias("least"))
    first = materialise(ranked(run(asks, True)).select("query_id", "vec_id", "score"), "home")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("kth"))
    again = asks.join(kth, "query_id", "left").withColumn("least", F.coalesce("kth", "least")).drop("kth")
    return ranked(first.union(run(again, False))).select("query_id", "rank", "vec_id", "score")
