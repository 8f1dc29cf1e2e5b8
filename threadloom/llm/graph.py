"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import counted, discard, materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of edges (a, b), by alternating large-star and small-star.

    The component is its least node; nodes without an edge to another are absent.
    """
    now = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        before = now
        now, state = counted(_small_star(_large_star(now)), "star", n=F.count("*"), s=F.sum(F.xxhash64("a", "b") % (1 << 40)))
        discard(before)
        if state == mark or not state["n"]:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    out = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component"))), "components")
    discard(now)
    return out


def union_find(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of edges (a, b), by hooking roots and jumping pointers.

    Every round hooks each root to the least neighbouring root and then halves
    all paths until they are flat; edges are rewritten to roots, and those
    within a tree fall away. The component is its least node.
    """
    edges = materialise(_ordered(edges), "edges")
    parent = None
    for _ in range(max_rounds):
        hooks = _both_ways(edges).groupBy("a").agg(F.min("b").alias("m")).where("m < a").select(F.col("a").alias("node"), F.col("m").alias("up"))
        hooks, some = counted(hooks, "hooks", n=F.count("*"))
        if not some["n"]:
            discard(hooks)
            break
        while True:  # pointer jumping, two steps at a time: hooks lead to smaller nodes, so they have no cycle
            up, over = (hooks.select(F.col("node").alias(low), F.col("up").alias(high)) for low, high in (("up", "top"), ("top", "peak")))
            jumped = hooks.select("node", "up").join(up, "up", "left").join(over, "top", "left")
            before = hooks
            hooks, some = counted(jumped.select("node", F.coalesce("peak", "top", "up").alias("up"), F.col("peak").isNotNull().alias("moved")), "hooks", moved=F.count_if("moved"))
            discard(before)
            if not some["moved"]:
                break
        roots = hooks.select(F.col("node").alias("r"), F.col("up").alias("top"))
        new = hooks.select("node", "up")
        if parent is not None:
            new = parent.join(roots, F.col("up") == F.col("r"), "left").select("node", F.coalesce("top", "up").alias("up")).union(new)
        left = edges
        for end in ("a", "b"):
            left = left.join(roots, F.col(end) == F.col("r"), "left").withColumn(end, F.coalesce("top", end)).select("a", "b")
        before = [edges, hooks] + [parent] * (parent is not None)
        parent = materialise(new, "parents")
        edges, some = counted(_ordered(left), "edges", n=F.count("*"))
        discard(*before)
        if not some["n"]:
            break
    else:
        raise RuntimeError("components did not settle")
    if parent is None:
        out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    else:
        top = parent.select(F.col("up").alias("node")).distinct()
        out = parent.select("node", F.col("up").alias("component")).union(top.select("node", F.col("node").alias("component")))
    out = materialise(out, "components")
    discard(edges, *([parent] * (parent is not None)))
    return out


def extended(comp: DataFrame, links: DataFrame, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The components (node, component), stored, with further links (a, b); comp itself if these join nothing, else it is deleted.

    Only links between different components are solved, with a component as one node: these are far fewer than what
    comp was made of.
    """
    for end in "ab":
        of = comp.select(F.col("node").alias(end), F.col("component").alias("top"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("top", end)).select("a", "b")
    between, some = counted(_ordered(links), "between", n=F.count("*"))
    if not some["n"]:
        discard(between)
        return comp
    roots = solve(between)
    up = roots.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = comp.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    out = materialise(old.union(roots.join(comp, "node", "left_anti").select("node", "component")), "components")
    discard(comp, between, roots)
    return out


def open_members(placed: DataFrame, least: float) -> DataFrame:
    """Rows of a bucket's members that may reach a Jaccard similarity of `least` to one in another component.

    placed: bucket, x (member), n (size of its set), component, and lo and hi, bounds of its Jaccard distance to one
    member of the bucket; the triangle inequality excludes members.
    """
    # Per bucket the two components with the least lower bounds: what stands nearest beside a member's own component.
    # Each task sends on two rows of a bucket at most, however many components it has.
    nearest = Window.partitionBy("bucket").orderBy("lo0", "component")
    two = placed.groupBy("bucket", "component").agg(F.min("lo").alias("lo0")).withColumn("k", F.row_number().over(nearest)).where("k <= 2")
    ends = F.struct("lo0", "component")
    second = two.groupBy("bucket").agg(F.min(ends).alias("first"), F.max(ends).alias("second"), F.count("*").alias("c")).where("c > 1")
    other = F.when(F.col("component") == F.col("first.component"), F.col("second.lo0")).otherwise(F.col("first.lo0"))
    second = second.select("bucket", "first", "second")
    return placed.join(second, "bucket").where(other - F.col("hi") <= 1 - least + 1e-9).select(*placed.columns)


def purest_leaders(members: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """bucket, x, n, leader, ln: every bucket's open members with the one that has least of its own, by share, as leader.

    In a group of copies that were changed each for itself it stands nearest to what they were copied from.
    """
    shared = members.join(own, "x", "left").withColumn("m", (F.col("n") - F.coalesce("u", F.lit(0))) / F.col("n")).where(F.col("m") >= least - 1e-9)
    lead = shared.groupBy("bucket").agg(F.max(F.struct("m", "x", "n")).alias("lead")).select("bucket", F.col("lead.x").alias("leader"), F.col("lead.n").alias("ln"))
    return shared.select("bucket", "x", "n").join(lead, "bucket")


#: Members of a bucket that one block holds; a task compares two blocks.
BLOCK = 2048


def in_blocks(u: DataFrame, v: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (bucket, a, ...) and (bucket, b, ...) of a bucket's pairs with keys `row` and `column`: a member lies in one of
    count / BLOCK blocks by its hash, and its copies meet every block of the other side, so that a large bucket is no one task's."""
    blocks = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    u, v = (side.join(blocks, "bucket").withColumn("own", F.pmod(F.xxhash64(k), F.col("blocks")).cast("int")) for side, k in ((u, "a"), (v, "b")))
    return u.withColumn("column", every).withColumnRenamed("own", "row").drop("blocks"), v.withColumn("row", every).withColumnRenamed("own", "column").drop("blocks")


def open_pairs(members: DataFrame, own: DataFrame, sketches: DataFrame, least: float, carry: tuple[str, ...] = (), also: Column | None = None) -> DataFrame:
    """Distinct pairs (a, b) of a bucket that lie in different components and can reach a Jaccard similarity of `least`.

    members: as open_members gives them; own: (x, u), how many elements of x's set no other member has; sketches:
    (x, sketch), longs whose bits are flipped by each element whose hash names them. What two sets have in
    common is at most what either shares with anyone, and common elements cancel in the exclusive or of two sketches:
    it has at most as many bits as the sets differ in elements, and nearly as many while these are few beside the bits.
    So a member of which more than 1 - `least` is its own is similar to none, and of the pairs only those go on whose
    bounds reach `least`. A null sketch excludes nothing. `also`: a further condition on a pair, over the columns `carry` with
    the suffixes a and b and na and nb.
    """
    shared = members.join(own, "x", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")
    left = open_members(shared.where(F.col("m") >= F.col("n") * least - 1e-9), least).join(sketches, "x", "left")
    u, v = (left.select("bucket", F.col("x").alias(k), *(F.col(c).alias(c + k) for c in ("n", "m", "component", "lo", "hi", "sketch", *carry))) for k in "ab")
    reach = 1 - least + 1e-9
    apart = (F.col("loa") - F.col("hib") > reach) | (F.col("lob") - F.col("hia") > reach)
    common = F.least("ma", "mb")
    enough = common >= (F.col("na") + F.col("nb") - common) * least - 1e-9
    differ = F.aggregate(F.zip_with("sketcha", "sketchb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)
    near = F.coalesce(differ <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-9, F.lit(True))
    u, v = in_blocks(u, v, members)
    return u.join(v, ["bucket", "row", "column"]).where((F.col("a") < F.col("b")) & (F.col("componenta") != F.col("componentb")) & ~apart & enough & near & (F.lit(True) if also is None else also)).select("a", "b").distinct()
