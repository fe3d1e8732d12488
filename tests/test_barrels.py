"""Exports followed through barrels against a depth-first search."""

import random

import pytest

from loomgraph.operators.resolve import export_steps, follow_barrels


def tables(spark, declared, forwarded, stars, wanted):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    return made(wanted, "file string, name string"), made(declared, "file string, name string"), made(forwarded, "file string, name string, original string, source string"), made(stars, "file string, ord int, source string")


def search(file, name, declared, forwarded, stars, visited=None):
    visited = set() if visited is None else visited
    if (file, name) in visited:
        return None
    visited.add((file, name))
    if (file, name) in declared:
        return file
    for f, n, original, source in forwarded:
        if (f, n) == (file, name) and (hit := search(source, original, declared, forwarded, stars, visited)):
            return hit
    for source in [s for _, s in sorted((o, s) for f, o, s in stars if f == file)]:
        if hit := search(source, name, declared, forwarded, stars, visited):
            return hit
    return None


@pytest.mark.parametrize(("seed", "rings"), [(0, False), (1, False), (2, True), (3, True)])
def test_exports_are_those_of_a_depth_first_search(spark, seed, rings):
    rng = random.Random(seed)
    n = 14
    stars = [(f"f{i}", k, f"f{rng.randrange(n) if rings else rng.randrange(i)}") for i in range(1, n) for k in range(rng.randrange(4))]
    declared = {(f"f{rng.randrange(n)}", f"n{rng.randrange(6)}") for _ in range(18)} | {("f0", "default")}
    forwarded = [] if rings else [(f"f{i}", f"n{k}", f"n{rng.randrange(6)}", f"f{rng.randrange(i)}") for i in range(3, n) for k in range(6) if rng.random() < 0.15]
    wanted = [(f"f{i}", f"n{k}") for i in range(n) for k in range(6)] + [(f"f{i}", "default") for i in range(n)]
    got = {(r["file"], r["name"]): r["target"] for r in follow_barrels(*tables(spark, sorted(declared), forwarded, stars, wanted)).collect()}
    assert got == {(f, x): search(f, x, declared, forwarded, stars) or f for f, x in wanted}


def test_steps_are_shared(spark):
    """A thousand importers of one deep barrel ask for its exports once, not once each."""
    stars = [(f"b{i}", 0, f"b{i + 1}") for i in range(6)] + [(f"user{i}", 0, "b0") for i in range(1000)]
    wanted = [(f"user{i}", "X") for i in range(1000)]
    w, d, f, s = tables(spark, [("b6", "X")], [], stars, wanted)
    assert export_steps(w, d, f, s).count() == 1000 + 6
    assert {r["target"] for r in follow_barrels(w, d, f, s).collect()} == {"b6"}
