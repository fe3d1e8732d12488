"""Reachability, components and fixpoints within files against brute force, and how many rounds they take."""

import random

import pytest

from loomgraph.operators import graph, within


def table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def reach(after, starts):
    seen, todo = set(), list(starts)
    while todo:
        for b in after.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def components(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    far = {n: reach(after, [n]) for n in {x for p in pairs for x in p}}
    return {n: min(m for m in far[n] if n in far[m]) for n in far if n in far[n]}


def test_parents_by_doubling(spark):
    rows = [(i, i - 1) for i in range(1, 300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (2000, 1000), (3000, 3000), (4000, 5)]
    got = {r["node"]: (r["head"], r["circling"]) for r in graph.followed(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert all(got[i] == (0, False) for i in [*range(1, 300), 4000]) and all(got[i][1] for i in (1000, 1001, 1002, 2000, 3000))
    low = {r["node"]: r["low"] for r in graph.followed(spark.createDataFrame([((i + 1) % 50, i) for i in range(50)], "node long, parent long")).collect()}
    assert set(low.values()) == {0}


def test_a_long_path_takes_few_rounds(spark):
    path = spark.range(10_000).selectExpr("id as src", "id + 1 as dst")
    trace = []
    assert graph.reachable(path, spark.createDataFrame([(4000,)], "node long"), trace=trace).count() == 6000
    assert trace.count("hung") <= 2 and trace.count("frontier") <= 2


@pytest.mark.parametrize("seed", range(3))
def test_reachability_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, rng.randrange(max(1, i - 3), i + 2)) for i in range(1, 60)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(20)] + [(200 + i, 201 + i) for i in range(40)] + [(240, 200), (300, 300)]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    starts = [rng.randrange(60), 210, 300]
    for include in (False, True):
        got = sorted(r["node"] for r in graph.reachable(table(spark, pairs), spark.createDataFrame([(n,) for n in starts], "node long"), include).collect())
        assert got == sorted(reach(after, starts) | (set(starts) if include else set()))


def test_a_chain_of_cycles_takes_few_rounds(spark):
    twos = [(2 * i, 2 * i + 1) for i in range(1000)] + [(2 * i + 1, 2 * i) for i in range(1000)] + [(2 * i + 1, 2 * i + 2) for i in range(999)]
    trace = []
    got = {r["node"]: r["component"] for r in graph.scc(table(spark, twos), trace).collect()}
    assert got == {n: n - n % 2 for n in range(2000)} and len(trace) < 15


def test_colours_split_a_chain_of_dense_components(spark):
    """Complete directed triangles with both ways missing: nothing merges, and colourings are few all the same."""
    pairs, n = [], 24
    for i in range(n):
        v = [5 * i + k for k in range(5)]
        pairs += [(v[a], v[b]) for a in range(5) for b in range(5) if (b - a) % 5 in (1, 2)]
        if i + 1 < n:
            pairs += [(v[0], v[0] + 5), (v[1], v[1] + 6), (v[2], v[2] + 7)]
    trace = []
    got = {r["node"]: r["component"] for r in graph.scc(table(spark, pairs), trace).collect()}
    assert got == {x: x - x % 5 for x in range(5 * n)} and trace.count("coloured") < 12


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(50), rng.randrange(50)) for _ in range(rng.choice([40, 60, 90]))]
    pairs += [(100 + i, 100 + (i + 1) % 17) for i in range(17)] + [(200 + i, 201 + i) for i in range(20)] + [(220, 205), (7, 100), (300, 300), (210, 7)]
    components_of = graph.scc(table(spark, pairs))
    want = components(pairs)
    assert {r["node"]: r["component"] for r in components_of.collect()} == want
    flat = {(want.get(a, a), want.get(b, b)) for a, b in pairs}
    assert {tuple(r) for r in graph.condensed(table(spark, pairs), components_of).collect()} == {(a, b) for a, b in flat if a != b}


def test_edges_against_the_order_bound_where_cycles_are(spark):
    """A deep graph of ascending edges takes no colouring, for a few descending ones bound the segments that cycles lie in."""
    rng = random.Random(5)
    pairs = [(a, b) for a in range(0, 400, 2) for b in rng.sample(range(a + 1, a + 60), 6)] + [(50, 48), (48, 50), (90, 70), (70, 80), (80, 90), (200, 190), (300, 300)]
    for flip in (False, True):
        turned = [(-a, -b) if flip else (a, b) for a, b in pairs]
        trace = []
        got = {r["node"]: r["component"] for r in graph.scc(table(spark, turned), trace).collect()}
        assert got == components(turned) and trace[0] == "segments" and "coloured" not in trace


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_dense_graph_is_joined_up_by_a_few_edges_of_each_node(spark, kind):
    rng = random.Random(6)
    name = (lambda n: n) if kind == "long" else (lambda n: f"n{n:03}")
    pairs = [(name(base + a), name(base + rng.randrange(40))) for base in (0, 100) for a in range(40) for _ in range(25)] + [(name(0), name(100)), (name(300), name(5)), (name(110), name(301))]
    trace = []
    components_of = graph.scc(spark.createDataFrame(pairs, f"src {kind}, dst {kind}"), trace)
    assert {r["node"]: r["component"] for r in components_of.collect()} == components(pairs)
    assert trace[0] == "picked" and trace.count("coloured") <= 2


def test_empty_graphs(spark):
    none = table(spark, [])
    assert graph.scc(none).count() == 0 and graph.reachable(none, spark.createDataFrame([(1,)], "node long")).count() == 0
    assert [r["node"] for r in graph.reachable(none, spark.createDataFrame([(1,)], "node long"), include_seeds=True).collect()] == [1]


@pytest.mark.parametrize("most", [100_000, 5, 0])
def test_fixpoint_within_groups(spark, most):
    """The same names are alive whether groups are gathered or go through rounds, hot groups among them."""
    rng = random.Random(9)
    refs = [(f"f{g}", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for g in range(12) for _ in range(g)] + [("hot", f"n{i}", f"n{i + 1}") for i in range(300)] + [("f1", None, "n1"), (None, "n1", "n2")]
    seeds = [(f"f{g}", f"n{g % 9}") for g in range(0, 14, 2)] + [("hot", "n250"), ("alone", "x"), ("f2", None), ("f2", "n2")]
    got = within.alive_within(spark.createDataFrame(refs, "path string, src string, dst string"), spark.createDataFrame(seeds, "path string, node string"), most=most).collect()
    want = set()
    for g, n in seeds:
        if n is not None:
            after = {}
            for p, a, b in refs:
                if p == g and a is not None:
                    after.setdefault(a, set()).add(b)
            want |= {(g, x) for x in reach(after, [n]) | {n}}
    assert sorted(map(tuple, got)) == sorted(want)
