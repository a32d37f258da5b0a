"""Pairs of nodes are searched between their heights only, and found as by plain search, where heights are known and where not."""

from __future__ import annotations

import random

import pytest

from skeinlake.operators import graph


def leads(edges, begin):
    seen, open_ = {begin}, [begin]
    while open_:
        for dst in edges.get(open_.pop(), ()):
            if dst not in seen:
                seen.add(dst)
                open_.append(dst)
    return seen


def plain(edges, pairs):
    out = {}
    for src, dst in edges:
        out.setdefault(src, set()).add(dst)
    return sorted({(a, b) for a, b in pairs if b in leads(out, a)})


@pytest.mark.parametrize("deep", [1, 32])
def test_ways_through_cycles_and_heights(spark, monkeypatch, deep):
    monkeypatch.setattr(graph, "DEEP", deep)
    rng = random.Random(deep)
    edges = {(n, rng.randrange(max(0, n - 9), n)) for n in range(1, 60) for _ in range(2)} | {(20, 31), (40, 40), (70, 71), (71, 72)}
    pairs = [(rng.randrange(62), rng.randrange(62)) for _ in range(120)] + [(5, 5), (70, 72), (72, 70), (99, 99), (99, 1)]
    found = graph.connected(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(pairs, "begin long, goal long"))
    assert sorted(tuple(r) for r in found.collect()) == plain(edges, pairs)


def test_searches_do_not_grow_with_what_hangs_below_a_goal(spark, monkeypatch):
    """A tree whose low nodes have most others above them: rows that the steps of a search write."""
    written, cut = [], graph.cut

    def counted(rows):
        held = cut(rows)
        if "begin" in held.columns:
            written.append(held.count())
        return held

    monkeypatch.setattr(graph, "cut", counted)
    n = 2000
    pairs = [(k, k // 3 + 1) for k in range(1, n)]
    edges = [(k, k // 2) for k in range(2, n)]
    found = graph.connected(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs, "begin long, goal long"))
    assert sorted(tuple(r) for r in found.collect()) == plain(edges, pairs)
    assert sum(written) < 5 * n
