"""Open members of buckets and components against plain Python."""

import numpy as np

from threadloom.llm import graph


def test_open_members_need_two_rows_of_a_bucket(spark):
    rng = np.random.default_rng(3)
    rows = [(int(b), int(x), 10, int(c), float(lo), float(min(1.0, lo + w))) for x, (b, c, lo, w) in enumerate(zip(rng.integers(0, 30, 600), rng.integers(0, 12, 600), rng.random(600), rng.random(600) / 2))]
    rows += [(99, 1000 + k, 10, 5, 0.0, 0.1) for k in range(5)]  # a bucket of one component
    placed = spark.createDataFrame(rows, "bucket long, x long, n int, component long, lo double, hi double").repartition(3)
    found = graph.open_members(placed, 0.75)
    want = {r[1] for r in rows if any(q[0] == r[0] and q[3] != r[3] and q[4] - r[5] <= 0.25 + 1e-9 for q in rows)}
    assert {r.x for r in found.collect()} == want
    # No join makes a row per component of a bucket: the nearest two are picked before the shuffle.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "WindowGroupLimit" in plan


def test_long_paths_are_one_component(spark):
    order = np.random.default_rng(4).permutation(200).tolist()
    edges = [*zip(order, order[1:]), (500, 501), (501, 502)]
    found = graph.union_find(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == dict.fromkeys(range(200), 0) | dict.fromkeys((500, 501, 502), 500)


def test_further_links_are_solved_between_components_only(spark):
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for solve in (graph.union_find, graph.star_components):
        first = [(1, 2), (2, 3), (5, 6), (8, 9)]
        comp = solve(edges(first))
        assert graph.extended(comp, edges([(3, 1), (6, 5)]), solve) is comp and comp.count() == 7  # nothing is joined
        assert graph.extended(comp, edges([]), solve) is comp
        given = []

        def watched(between, solve=solve):
            given.extend(sorted((r.a, r.b) for r in between.collect()))
            return solve(between)

        found = graph.extended(comp, edges([(6, 3), (3, 1), (2, 5), (0, 9), (20, 21)]), watched)
        assert {r.node: r.component for r in found.collect()} == dict.fromkeys((1, 2, 3, 5, 6), 1) | dict.fromkeys((0, 8, 9), 0) | {20: 20, 21: 20}
        assert given == [(0, 8), (1, 5), (20, 21)] and found.count() == 10


def test_empty_edges_and_few_queries(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert graph.union_find(none).count() == 0 and graph.star_components(none).count() == 0
    store = spark._jsparkSession.sharedState().statusStore()
    pairs = spark.createDataFrame([(k, k + 1000) for k in range(50)], "a long, b long")
    before = store.executionsCount()
    assert graph.union_find(pairs).count() == 100
    # edges, hooks, jump, parents, edges, components and the count: emptiness is seen while tables are written.
    assert store.executionsCount() - before == 7
