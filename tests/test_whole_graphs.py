"""Graph queries run over every row, by brute force."""

import os

import pytest

from roadloom.operators import graphs as G
from roadloom.plans import bridge as B
from roadloom.plans import catalogue_more, catalogue_roads

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def parts(nodes, edges):
    """(least node, number of nodes) of each component."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    count = {}
    for n in nodes:
        count[root(n)] = count.get(root(n), 0) + 1
    return count


def test_junctions_of_all_chains(spark):
    chains = {}
    for r in B.load(spark, DATA, "lineitem").select("l_orderkey", "l_partkey").collect():
        chains.setdefault(r[0], []).append(r[1])
    edges = []
    for end in (min, max):
        first = {}
        edges += [(first.setdefault(end(v), k), k) for k, v in chains.items()]
    assert {r.component: r.chains for r in catalogue_roads.junction_clusters(spark, DATA).collect()} == parts(chains, edges)


def test_reach_of_all_lanes(spark):
    ways = {r.way_id for r in B.ways(spark, DATA).collect()}
    want = set()
    for w in ways:
        n, hops = w, 0
        want.add((w, n, hops))
        while hops < 3 and n % 5 < 4 and n + 1 in ways:
            n, hops = n + 1, hops + 1
            want.add((w, n, hops))
    assert {(r.seed, r.node, r.hops) for r in catalogue_more.bounded_reach(spark, DATA).collect()} == want


def test_intersections_of_all_ends(spark):
    used = {r.end_node for r in B.ends(spark, DATA).collect()}
    at = {r.node_id: (r.x, r.y) for r in B.nodes(spark, DATA).collect() if r.node_id in used}
    edges = [(a, b) for a in at for b in at if a < b and (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= 100]
    assert {r.component: r.merged for r in catalogue_roads.close_intersections(spark, DATA).collect()} == parts(at, edges)


def test_components_of_a_winding_grid_need_few_rounds(spark):
    import random

    rng = random.Random(5)
    cells = [k for k in range(6000) if rng.random() < 0.62]
    name = {k: rng.randrange(10**9) for k in cells}
    edges = [(name[a], name[b]) for a in cells for b in ([a + 1] if a % 50 < 49 else []) + [a + 50] if b in name]
    got = G.components(spark.createDataFrame([(n,) for n in name.values()], "node long"), spark.createDataFrame(edges, "src long, dst long"), most_rounds=10)
    assert {r.component: r["count"] for r in got.groupBy("component").count().collect()} == parts(name.values(), edges)
