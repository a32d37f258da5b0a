"""Rounds over chains send no table of all nodes through the driver, however small its files are."""

from __future__ import annotations

from skeinlake.operators import graph


def test_rounds_of_chains_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], graph.cut

    def noted(rows):
        plans.append(rows._jdf.queryExecution().sparkPlan().toString())
        return cut(rows)

    monkeypatch.setattr(graph, "cut", noted)
    links, _ = graph.contracted(spark.range(40).selectExpr("id AS src", "id + 1 AS dst"))
    assert [tuple(r) for r in links.collect()] == [(0, 40, 40)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
