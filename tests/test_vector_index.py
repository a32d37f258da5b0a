"""The vector index against plain numpy: recall, hot lists, odd vectors, empty tables."""

from __future__ import annotations

import numpy as np
import pytest

from skeinlake.operators import neighbours, vector_index
from skeinlake.session import ship

SCHEMA = "id long, v array<float>"


def table(spark, matrix, first=0):
    return spark.createDataFrame([(first + k, [float(x) for x in row]) for k, row in enumerate(matrix)], SCHEMA)


@pytest.fixture
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 32))
    return centres[rng.integers(0, 20, 3000)] + rng.normal(0, 0.25, (3000, 32))


def test_recall_with_few_lists_probed(spark, tmp_path, clustered, monkeypatch):
    rows = table(spark, clustered)
    queries = rows.where("id % 50 = 0")
    index = vector_index.build(rows, "id", "v", f"file://{tmp_path}/index", lists=40)
    assert index.probes <= 20
    found = vector_index.search(ship(spark) and index, queries, "id", "v", 10).cache()
    facts = vector_index.recall(found, neighbours.batch_nearest(rows, queries, "id", "v", 10)).first()
    assert facts["queries"] == 60 and facts["neighbours"] == 600 and facts["recall"] >= 0.9
    unit = clustered / np.linalg.norm(clustered, axis=1)[:, None]
    for r in found.collect():
        assert abs(r["score"] - unit[r["query_id"]] @ unit[r["id"]]) < 1e-5 and r["id"] != r["query_id"]
    whole = vector_index.search(index, queries, "id", "v", 10, probes=40, rerank=10_000)
    assert vector_index.recall(whole, neighbours.batch_nearest(rows, queries, "id", "v", 10)).first()["recall"] == 1.0
    assert {r["list"]: r["rows"] for r in vector_index.status(spark, index).collect()} == index.sizes and sum(index.sizes.values()) == 3000


def test_copies_in_one_list_are_many_pieces(spark, tmp_path, clustered, monkeypatch):
    monkeypatch.setattr(vector_index, "PIECE_ROWS", 100)
    some = np.concatenate([clustered[:300], np.repeat(clustered[:1], 700, axis=0)])
    index = vector_index.build(table(ship(spark), some), "id", "v", f"file://{tmp_path}/index", lists=10)
    pieces = {r["list"]: r["pieces"] for r in vector_index.status(spark, index).collect()}
    assert max(pieces.values()) >= 7


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.1]), (None, [1.0, 1.0])], SCHEMA)
    index = vector_index.build(rows, "id", "v", f"file://{tmp_path}/a")
    found = vector_index.search(index, rows, "id", "v", 5, probes=9)
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(1, 2), (1, 5), (2, 1), (2, 5), (5, 1), (5, 2)]
    none = rows.where("id = -1")
    empty = vector_index.build(none, "id", "v", f"file://{tmp_path}/b")
    assert vector_index.search(empty, rows, "id", "v", 5).collect() == []
    assert vector_index.search(index, none, "id", "v", 5).collect() == []
