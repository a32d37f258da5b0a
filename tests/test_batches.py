"""Python tasks hold little at once, whatever comes in one batch, and give what they gave for the whole batch."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from skeinlake.functions import embedding
from skeinlake.operators import chunking, names, neighbours


def test_nearest_are_compared_in_tiles():
    """2,000 queries and 6,000 rows, a third of them copies: no matrix of all pairs, and the same as of brute force."""
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(6000, 8))
    matrix[2000:4000] = matrix[:2000]
    rows = pd.DataFrame({"id": np.arange(6000), "v": list(matrix)})
    queries = neighbours._units(rows[:2000].rename(columns={"id": "q"}))
    tracemalloc.start()
    found = neighbours._compared(queries, rows, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    units = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    for q in (0, 7, 255, 256, 1999):
        score = np.round(units @ units[q], 6)
        want = sorted((i for i in range(6000) if i != q), key=lambda i: (-score[i], i))[:5]
        assert found[found["query_id"] == q]["id"].tolist() == want


def test_hits_of_names_go_out_after_some_texts():
    class Every:
        def iter(self, text):
            return ((k, f"n{k}") for k in range(len(text) // 1000))

    rows = pd.DataFrame({"id": range(50), "text": ["x" * 100_000] * 49 + [""]})
    parts = list(names._hits(rows, Every()))
    assert len(parts) == 5 and max(map(len, parts)) <= 1000
    found = pd.concat(parts)
    assert sorted(zip(found["id"], found["low"], strict=True)) == sorted((i, f"n{k}") for i in range(49) for k in range(100))


class Captured:
    """Stands for a DataFrame; gives the task that a step would run."""

    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, task, _):
        return task

    mapInPandas = mapInArrow


def test_chunks_go_out_after_some_texts():
    texts = ["word " * 20_000] * 40 + [None, "", "short"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = list(chunking.chunks(Captured(), ["doc_id"], "text", lambda t: [(0, len(t), t)] if t else [])(iter([batch])))
    assert max(b.nbytes for b in out) < 2 << 20
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["chunk_no"], r["chunk"]) for r in rows] == [(k, 0, t) for k, t in enumerate(texts) if t]


def test_vectors_go_out_after_some_texts():
    texts = ["word " * 20_000] * 30 + [None, " ", "short"]
    out = list(embedding.with_vectors(Captured(), ["doc_id"], "text", 8)(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})])))
    assert len(out) > 2 and max(b["text"].str.len().sum() for b in out) <= 1 << 20
    rows = pd.concat(out)
    assert rows["doc_id"].tolist() == list(range(len(texts)))
    assert [v is None for v in rows["vector"]] == [not (t and t.strip()) for t in texts]
    assert (rows["vector"].iloc[-1] == embedding.seeded("short", 8)).all()
