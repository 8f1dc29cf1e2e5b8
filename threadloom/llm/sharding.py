"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows of every source partition are counted. For each partition the driver
draws how many of its rows each target receives: a multivariate hypergeometric
row over what the targets can still take, which is the law of a uniform
permutation. Each partition permutes its rows and deals them out accordingly;
after the exchange each target permutes again. A shard is a run of targets of
nearly equal size, so that no task holds a whole shard. Of very many partitions,
neighbours form groups: the driver draws the groups' rows, and a task draws
those of the partitions of its group.

Rows are taken as they come: nulls and repeated rows are rows like others, and
an empty table gives an empty result. By the law `rows` equal texts may lie in
different shards. Columns named `shard` or `slot` are replaced. The draw depends on the seed, the table
and its split into partitions only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import materialise

#: Most cells of the communication matrix (driver memory), and rows that a target should hold.
MAX_CELLS, TARGET_ROWS = 1 << 24, 2048
#: Most rows of the matrix that the driver draws: beyond so many partitions, neighbours form groups, and the tasks draw the partitions of a group.
MAX_GROUPS = 4096
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw; numpy's own up to its limit, beyond it by rejection."""
    if not draws or not good or not bad:
        return min(good, draws)
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    if draws == good + bad:
        return good
    return _urn(rng, good, bad, draws)


def _urn(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Hypergeometric draw by rejection from its ratio-of-uniforms hat (Stadlober's HRUA)."""
    from math import exp, lgamma, log, sqrt

    small, large = min(good, bad), max(good, bad)
    n, m = good + bad, min(draws, good + bad - draws)
    p, q = small / n, large / n
    mean = m * p
    a = mean + 0.5
    var = (n - m) * m * p * q / (n - 1) + 0.5
    c = 1.7155277699214135 * sqrt(var) + 0.8989161620588988
    mode = int((m + 1) * (small + 1) / (n + 2))
    f = lambda k: lgamma(k + 1) + lgamma(small - k + 1) + lgamma(m - k + 1) + lgamma(large - m + k + 1)
    top, g = min(min(m, small) + 1, int(a + 16 * sqrt(var))), f(mode)
    while True:
        u, v = rng.random(), rng.random()
        x = a + c * (v - 0.5) / u
        if not 0 <= x < top:
            continue
        k = int(x)
        t = g - f(k)
        if u * (4 - u) - 3 <= t or (u * (u - t) < 1 and 2 * log(u) <= t):
            break
    if good > bad:
        k = m - k
    return good - k if m < draws else k


def multivariate(rng: np.random.Generator, room: np.ndarray, draws: int) -> np.ndarray:
    if room.sum() < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(room, draws, method="marginals")
    out, left = np.zeros_like(room), int(room.sum())
    for k, r in enumerate(room.tolist()):
        out[k] = hypergeometric(rng, r, left - r, draws)
        draws, left = draws - int(out[k]), left - r
    return out


def row_of(at: int, counts: np.ndarray, row: np.ndarray, seed: list[int]) -> np.ndarray:
    """The row of the partition at place `at` of a group: the group's row, dealt to its partitions in turn by draws that every task repeats alike."""
    rng, left = np.random.default_rng(seed), row.copy()
    for k, n in enumerate(counts[:-1].tolist()):
        own = multivariate(rng, left, n)
        if k == at:
            return own
        left -= own
    return left


def shards(df: DataFrame, n_shards: int = 8, seed: int = 0, size: Column | None = None) -> DataFrame:
    """Add `shard` (0 to n_shards - 1; row counts at most one apart) and `slot` (gapless from 0, a uniform order); they replace columns of these names, all others stay.

    A long text is not moved: pass the narrow columns that are wanted and join by key.
    """
    names = df.columns
    own, pid, at, target = "own", "pid", "at", "target"  # beside a struct of all given columns, whatever their names
    df = materialise(df.select(F.struct(*names).alias(own), F.spark_partition_id().alias(pid), F.monotonically_increasing_id().alias(at)), "shards")
    counts = {r[0]: r[1] for r in df.groupBy(pid).count().collect()}  # one row per partition
    total, parts = sum(counts.values()), sorted(counts)
    sizes = [total * (s + 1) // n_shards - total * s // n_shards for s in range(n_shards)]
    n_groups = min(len(parts), MAX_GROUPS)
    per = max(1, min(-(-max(sizes) // TARGET_ROWS), MAX_CELLS // (n_shards * max(1, n_groups))))
    room = np.array([s * (k + 1) // per - s * k // per for s in sizes for k in range(per)], np.int64)
    part_of, rows_of = np.array(parts, np.int64), np.array([counts[p] for p in parts], np.int64)
    ends = [len(parts) * (k + 1) // n_groups for k in range(n_groups)]
    rng, left, deal = np.random.default_rng(seed), room.copy(), []
    for begin, end in zip([0, *ends], ends):
        row = multivariate(rng, left, int(rows_of[begin:end].sum()))
        left -= row
        deal.append((begin, end, np.flatnonzero(row).astype(np.int32), row[row > 0]))
    sent = df.sparkSession.sparkContext.broadcast((part_of, rows_of, ends, deal))  # at most MAX_CELLS counts, and two numbers per partition
    wide = [own, pid, at]

    def run(batches):
        # Files keep a partition's rows together, but a task may hold several partitions, or parts of one.
        order: dict[int, np.ndarray] = {}
        part_of, rows_of, ends, deal = sent.value
        for batch in batches:
            p, a = batch.column(pid).to_numpy(), batch.column(at).to_numpy() & ((1 << 33) - 1)
            out = np.empty(len(p), np.int32)
            for q in np.unique(p).tolist():
                if q not in order:
                    place = int(np.searchsorted(part_of, q))
                    begin, end, ids, row = deal[int(np.searchsorted(ends, place, side="right"))]
                    n = row_of(place - begin, rows_of[begin:end], row, [seed, begin, end])
                    order[q] = np.random.default_rng([seed, q]).permutation(np.repeat(ids, n))
                mine = p == q
                out[mine] = order[q][a[mine]]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in wide), pa.array(out)], names=[*wide, target])

    dealt = df.select(*wide).mapInArrow(run, T.StructType([*df.select(*wide).schema.fields, T.StructField(target, T.IntegerType())]))
    shard = (F.col(target) / per).cast("int")
    shard_sizes = F.array(*(F.lit(s).cast("long") for s in sizes))
    base = F.expr(f"n * (target % {per}) div {per}")
    w = Window.partitionBy(target).orderBy(F.xxhash64(F.lit(seed), F.col(at)), F.col(at))
    return (
        dealt.withColumn("rn", F.row_number().over(w))
        .withColumn("shard", shard)
        .withColumn("n", F.element_at(shard_sizes, F.col("shard") + 1))
        .withColumn("slot", base + F.col("rn") - 1)
        .select(*(F.col(own)[c].alias(c) for c in names if c not in ("shard", "slot")), "shard", "slot")
    )
