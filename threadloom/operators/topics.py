"""Topics: density clusters of window vectors, their terms, examples and course over time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as fx
from . import density


def window_records(index: DataFrame, chat_id: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Window vectors; one without a start date passes every date filter."""
    rows = index.where("kind = 'window'")
    if chat_id:
        rows = rows.where(F.col("chat_id") == chat_id)
    start = F.coalesce("start_date", F.lit(""))
    if date_from:
        rows = rows.where((start == "") | (start >= date_from))
    return rows.where((start == "") | (start <= date_to)) if date_to else rows


def subsample(records: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """A seeded sample of at most `most` rows, for a quick look; 0 or None keeps all."""
    return records.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most) if most else records


def reduce(x: np.ndarray, dim: int = 48) -> np.ndarray:
    """Rows scaled to length one, projected to their principal axes where that is fewer, and scaled again."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    x = unit(x)
    if x.shape[1] > dim and len(x) > dim + 1:
        centred = x - x.mean(axis=0)
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        x = unit(centred @ axes[:dim].T)
    return x


def density_clusters(x: np.ndarray, least: int) -> np.ndarray:
    """HDBSCAN of one array, against which density.clusters is tested: mutual reachability, minimum spanning tree, condensed tree, excess of mass; -1 is noise."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1)
    sq = (x * x).sum(axis=1)
    dist = lambda i: np.sqrt(np.maximum(sq + sq[i] - 2 * x @ x[i], 0))
    k = min(least, n) - 1
    core = np.array([np.partition(dist(i), k)[k] for i in range(n)])
    edges = sorted((w, int(a), int(b)) for a, b, w in zip(*density.spanning_tree(x, core)[:3]))
    # Single linkage as a dendrogram.
    parent, node, size = list(range(n)), list(range(n)), [1] * n
    children, height = {}, {}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step, (d, a, b) in enumerate(edges):
        a, b, new = root(a), root(b), n + step
        children[new], height[new] = (node[a], node[b]), d
        size.append(size[node[a]] + size[node[b]])
        parent[b], node[a] = a, new
    # Condense: a split counts only where both sides have `least` points.
    birth, fall, kids, stack = {0: 0.0}, {}, {0: []}, [(2 * n - 2, 0)]
    gone: list[tuple[int, int, float]] = []
    while stack:
        at, cluster = stack.pop()
        if at < n:
            gone.append((at, cluster, np.inf))
            continue
        lam = 1 / height[at] if height[at] > 0 else np.inf
        a, b = children[at]
        if size[a] >= least and size[b] >= least:
            fall[cluster] = lam
            for side in (a, b):
                new = len(birth)
                birth[new], kids[new] = lam, []
                kids[cluster].append(new)
                stack.append((side, new))
            continue
        for side in (a, b):
            if size[side] >= least:
                stack.append((side, cluster))
            else:
                leaves, todo = [], [side]
                while todo:
                    t = todo.pop()
                    leaves.append(t) if t < n else todo.extend(children[t])
                gone += [(leaf, cluster, lam) for leaf in leaves]
    members: dict[int, list[int]] = {c: [] for c in birth}
    for point, c, _ in gone:
        members[c].append(point)
    top = max([lam for _, _, lam in gone if np.isfinite(lam)] + [1.0])
    weight = dict.fromkeys(birth, 0.0)
    for _, c, lam in gone:
        weight[c] += min(lam, top) - min(birth[c], top)
    total = {}
    for c in sorted(birth, reverse=True):
        total[c] = len(members[c]) + sum(total[k] for k in kids[c])
        if kids[c]:
            weight[c] += sum(total[k] for k in kids[c]) * (min(fall[c], top) - min(birth[c], top))
    # Excess of mass, from the leaves up; the root is no cluster.
    chosen, value = set(), {}
    for c in sorted(birth, reverse=True):
        below = sum(value[k] for k in kids[c])
        if c and (not kids[c] or weight[c] >= below):
            value[c] = weight[c]
            todo = list(kids[c])
            while todo:
                k = todo.pop()
                chosen.discard(k)
                todo += kids[k]
            chosen.add(c)
        else:
            value[c] = below
    labels = np.full(n, -1)
    for number, c in enumerate(sorted(chosen)):
        todo = [c]
        while todo:
            k = todo.pop()
            labels[members[k]] = number
            todo += kids[k]
    return labels


def cluster(records: DataFrame, least: int = 5, dim: int = 48) -> DataFrame:
    """All records with `label` and `to_centre`, the distance to the cluster's centre in the reduced space."""
    return records.join(density.clusters(records.select("id", "embedding"), least, dim), "id")


def terms(docs: DataFrame, top: int = 8) -> DataFrame:
    """Class-based TF-IDF of rows (label, text): tf * ln(1 + mean words per cluster / clusters with the word); ties to the larger word."""
    words = docs.select("label", F.explode(fx.topic_words(F.col("text"))).alias("term"))
    tf = words.groupBy("label", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    mean = tf.agg((F.sum("tf") / F.countDistinct("label")).alias("mean"))  # one row
    weight = F.col("tf") * F.ln(1 + F.col("mean") / F.col("df"))
    w = Window.partitionBy("label").orderBy(F.desc("weight"), F.desc("term"))
    return tf.join(df, "term").join(F.broadcast(mean)).withColumn("weight", weight).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("label", "rank", "term", "weight")


def summary(clustered: DataFrame, n_terms: int = 8, n_examples: int = 3) -> DataFrame:
    """A row per cluster, largest first: size, terms, days, and the windows nearest its centre."""
    found = clustered.where("label >= 0")
    by = found.groupBy("label").agg(F.count("*").alias("size"), F.min(F.nullif("start_date", F.lit(""))).alias("start_date"), F.max(F.nullif("start_date", F.lit(""))).alias("end_date"))
    best = terms(found, n_terms).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("terms"))
    w = Window.partitionBy("label").orderBy("to_centre", "id")
    near = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_examples)
    near = near.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", "id", F.substring("text", 1, 300).alias("text")))).alias("examples"))
    return by.join(best, "label", "left").join(near, "label", "left").orderBy(F.desc("size"), "label")


def evolution(clustered: DataFrame, bucket: str = "month", top: int = 5) -> DataFrame:
    """Windows per period of the `top` largest clusters; windows without a valid day are left out."""
    found = clustered.where("label >= 0")
    largest = found.groupBy("label").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "label").limit(top)
    return found.join(F.broadcast(largest), "label", "left_semi").groupBy("label", fx.period(F.col("start_date"), bucket, week="-").alias("period")).agg(F.count("*").alias("count")).where("period is not null").orderBy("label", "period")


def analyse(index: DataFrame, chat_id: str | None = None, date_from: str | None = None, date_to: str | None = None, least: int = 5, most: int | None = None, bucket: str | None = None, n_terms: int = 8, n_examples: int = 3) -> dict[str, DataFrame]:
    records = window_records(index, chat_id, date_from, date_to)
    labelled = cluster(subsample(records, most), least)
    available = records.agg(F.count("*").alias("available"))
    out = {"available": available, "labels": labelled.select("id", "label"), "clusters": summary(labelled, n_terms, n_examples)}
    return out | ({"evolution": evolution(labelled, bucket)} if bucket else {})
