"""The four lists of a hybrid search, and their fusion, against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from skeinlake.operators import neighbours

K, CURRENT, HISTORY = 20, 17, [250, 3, *range(40, 100, 5)]


@pytest.mark.parametrize("history", [None, HISTORY])
def test_hybrid_of_all_lists(spark, history):
    rng = np.random.default_rng(11)
    n, query = 300, rng.normal(size=4)
    matrix = rng.normal(size=(n, 4))
    mentions = sorted({(int(i), f"c{int(c)}") for i, c in zip(rng.integers(0, n, 1200), rng.integers(0, 40, 1200), strict=True)})
    steps = [(int(a), int(b)) for a, b in zip(rng.integers(0, n, 400), rng.integers(0, n, 400), strict=True)]
    score = {i: round(float(v @ query / np.linalg.norm(v) / np.linalg.norm(query)), 6) for i, v in enumerate(matrix)}
    order = [i for i in sorted(score, key=lambda i: (-score[i], i)) if score[i] >= 0.5]

    semantic = {i: score[i] for i in order[:K]}
    boost = lambda i: 1.3 if i % 9 == CURRENT % 9 else 1.15 if i % 3 == CURRENT % 3 else 1
    contextual = {i: min(1, score[i] * boost(i)) for i in order[:K]}
    base = {i: score[i] for i in order[: K // 2]}
    held = {c for i, c in mentions if i in order[:5]}
    times = defaultdict(set)
    for i, c in mentions:
        if c in held and i not in base:
            times[i].add(c)
    some = sorted((i for i in times if len(times[i]) >= 2), key=lambda i: (-len(times[i]), i))[: K // 2]
    conceptual = base | {i: min(1, score[i] * (1 + 0.1 * len(times[i]))) for i in some}
    lists = [semantic, contextual, conceptual]
    if history:
        after = defaultdict(set)
        for learned in history[-10:]:
            ends = {learned}
            for _ in range(3):
                ends = {b for a, b in steps if a in ends}
                for i in ends - set(history) - set(base):
                    after[i].add(learned)
        lists.append(base | {i: min(1, score[i] * 1.2) for i in sorted(after, key=lambda i: (-len(after[i]), i))[: K // 2]})
    want = defaultdict(list)
    for found, weight in zip(lists, (0.4, 0.2, 0.3, 0.1), strict=False):
        for i, x in found.items():
            want[i].append((x, weight))
    assert len(want) > len(semantic) + (10 if history else 5)

    chunks = spark.createDataFrame([(i, v.tolist(), i % 9, i % 3) for i, v in enumerate(matrix)], "id long, vector array<double>, section long, chapter long")
    got = neighbours.hybrid(chunks, spark.createDataFrame(mentions, "id long, concept string"), spark.createDataFrame(steps, "src long, dst long"), query.tolist(), K, CURRENT, history).collect()
    assert {r["id"]: r["lists"] for r in got} == {i: len(x) for i, x in want.items()}
    for r in got:
        x = want[r["id"]]
        assert r["score"] == pytest.approx(sum(a * w for a, w in x) / sum(w for _, w in x), abs=3e-6)


@pytest.mark.parametrize("dimensions", [4096, 3])
def test_most_alike_rows(spark, monkeypatch, dimensions):
    """Both ways against numpy: rows without values in common, zeros, one column that nearly all rows have."""
    monkeypatch.setattr(neighbours, "MOST_DIMENSIONS", dimensions)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(8)
    table = {(r, c): float(rng.integers(0, 5)) for r in range(60) for c in range(12) if rng.random() < (0.9 if c == 0 else 0.15)} | {(99, "x"): 1.0}
    df = spark.createDataFrame([(r, str(c), v) for (r, c), v in table.items()] + [(5, None, 1.0), (None, "0", 1.0), (6, "7", None)], "r long, c string, v double")
    rows, columns = sorted({r for r, _ in table}), sorted({str(c) for _, c in table})
    matrix = np.zeros((len(rows), len(columns)))
    for (r, c), v in table.items():
        matrix[rows.index(r), columns.index(str(c))] = v
    size = np.linalg.norm(matrix, axis=1)
    score = np.round(matrix @ matrix.T / np.where(size == 0, 1, size)[:, None] / np.where(size == 0, 1, size), 6)
    want = []
    for i, r in enumerate(rows):
        order = sorted((-score[i, j], o) for j, o in enumerate(rows) if j != i and score[i, j] > 0)[:4]
        want += [(r, o, round(-s, 6)) for s, o in order]
    assert sorted(tuple(x) for x in neighbours.most_alike(df, "r", "c", "v", 4).collect()) == sorted(want)
