"""Graphs of any depth against plain Python: cycles, components, levels, reach, edges that would close a cycle."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from skeinlake.operators import graph

LONG = 1000
EDGES = "src long, dst long"


def reached(edges, start):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    seen, stack = {start}, [start]
    while stack:
        for n in after[stack.pop()] - seen:
            seen.add(n)
            stack.append(n)
    return seen


def components_of(edges):
    """Nodes on cycles with the least node of their component."""
    nodes = {n for e in edges for n in e}
    to = {n: reached(edges, n) for n in nodes}
    out = {}
    for n in nodes:
        own = {m for m in to[n] if n in to[m]}
        if len(own) > 1 or (n, n) in edges:
            out[n] = min(own)
    return out


def levels_of(edges, nodes):
    of = components_of(edges)
    down = defaultdict(set)
    for a, b in edges:
        if of.get(a, a) != of.get(b, b):
            down[of.get(a, a)].add(of.get(b, b))
    level = {}

    def find(start):
        stack = [start]
        while stack:
            n = stack[-1]
            missing = [m for m in down[n] if m not in level]
            if missing:
                stack += missing
            else:
                level[n] = max((level[m] + 1 for m in down[n]), default=0)
                stack.pop()

    for n in nodes:
        if of.get(n, n) not in level:
            find(of.get(n, n))
    return {n: (level[of.get(n, n)], n in of) for n in nodes}


def graphs():
    rng = random.Random(7)
    ring = [(k, (k + 1) % LONG) for k in range(LONG)]
    chain = [(k + 1, k) for k in range(LONG)]
    yield "ring", ring
    yield "chain", chain
    # A ring that a chain leads to and another leaves, with a shortcut, a loop and a second ring in a tail.
    yield "mixed", ring + [(5000 + k, 5000 + k + 1) for k in range(200)] + [(5200, 3)] + [(500, 6000)] + [(6000 + k, 6001 + k) for k in range(200)] + [(10, 500), (7000, 7000), (7000, 3), (6200, 7100), (7100, 7101), (7101, 7102), (7102, 7100)]
    for n, m in ((30, 40), (25, 80)):
        yield f"random {n} {m}", sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


GRAPHS = dict(graphs())


@pytest.mark.parametrize("name", ["ring", "chain", "mixed", "random 25 80"])
def test_components_and_levels(spark, name):
    edges = GRAPHS[name]
    nodes = sorted({n for e in edges for n in e} | {9999})
    df = spark.createDataFrame(edges, EDGES).repartition(3)
    assert {r["node"]: r["component"] for r in graph.strongly_connected(df).collect()} == components_of(set(edges))
    got = {r["node"]: (r["level"], r["on_cycle"]) for r in graph.levels(df, spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}
    assert got == levels_of(set(edges), nodes)


@pytest.mark.parametrize("name", ["chain", "mixed"])
def test_reach_and_closed_cycles(spark, name):
    edges = GRAPHS[name]
    rng = random.Random(1)
    nodes = sorted({n for e in edges for n in e})
    df = spark.createDataFrame(edges, EDGES)
    starts = rng.sample(nodes, 3)
    got = defaultdict(set)
    for r in graph.reachable(df, spark.createDataFrame([(n,) for n in starts], "node long")).collect():
        assert r["node"] not in got[r["start"]]
        got[r["start"]].add(r["node"])
    assert got == {s: reached(edges, s) for s in starts}
    proposed = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(8)] + [(nodes[0], nodes[0]), (nodes[-1], nodes[0]), (nodes[0], nodes[-1]), (12345, nodes[0])]
    found = graph.closes_cycle(df, spark.createDataFrame(proposed, EDGES)).collect()
    assert sorted((r["src"], r["dst"], r["is_cycle"]) for r in found) == sorted((a, b, a in reached(edges, b)) for a, b in proposed)


def test_empty_graph(spark):
    none, nodes = spark.createDataFrame([], EDGES), spark.createDataFrame([(1,), (2,)], "node long")
    assert graph.strongly_connected(none).collect() == []
    assert sorted(tuple(r) for r in graph.levels(none, nodes).collect()) == [(1, 0, False), (2, 0, False)]
    assert sorted(tuple(r) for r in graph.reachable(none, nodes).collect()) == [(1, 1), (2, 2)]
