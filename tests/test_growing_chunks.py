"""Chunks of texts that come in parts are those of the whole texts."""

from __future__ import annotations

import random

from skeinlake.operators import chunking
from skeinlake.streaming import chunks


def test_any_division_gives_the_same_chunks():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(["a" * rng.randrange(1, 30), " ", "\n", "\n\n", "\n\n\n", "word "]) for _ in range(rng.randrange(0, 40)))
        growing, found, rest = chunks.Growing(60), [], text
        while rest:
            n = rng.randrange(1, 25)
            found += growing.feed(rest[:n])
            growing, rest = chunks.Growing(60, __import__("json").dumps(growing.state())), rest[n:]
        assert found + growing.close() == chunking.greedy(text, 60)


def test_parts_out_of_order_and_repeated(spark, tmp_path):
    rng = random.Random(2)
    texts = {k: "\n\n".join("p" * rng.randrange(1, 400) for _ in range(rng.randrange(1, 12))) for k in range(6)} | {9: ""}
    rows = [(k, i // 300, t[i : i + 300] or None, i + 300 >= len(t)) for k, t in texts.items() for i in range(0, max(len(t), 1), 300)]
    rows += rows[:3]
    rng.shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], "doc_id long, part_no long, part string, last boolean").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/parts")
    stream = spark.readStream.schema("doc_id long, part_no long, part string, last boolean").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/parts")
    got = sorted((r["doc_id"], r["chunk_no"], r["begin"], r["finish"], r["chunk"]) for r in chunks.growing_chunks(stream, 500).collect())
    assert got == [(k, i, *c) for k, t in sorted(texts.items()) for i, c in enumerate(chunking.greedy(t, 500))]


def test_batches_held_between_them_without_a_call_for_each_document(spark, tmp_path, monkeypatch):
    """repeated parts (waiting, taken, and after the end), null parts, keys and ends, and a document whose end never comes."""
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    kind = "doc_id long, part_no long, part string, last boolean"
    batches = [
        [(1, 2, "ff", True), (2, 0, "aaaa\n\nbbbb\n", False), (3, 0, "x" * 9, None), (None, 0, "lost", True), (4, 1, None, True)],
        [(1, 0, "ccc\n\nddd", None), (2, 0, "again", False), (2, 2, "late", False), (3, 1, "\n\ny", None), (3, None, "lost", True), (4, 0, "  ", False), (5, -1, "lost", True)],
        [(1, 1, "\n\neeeeeee\n\n", False), (1, 2, "ff", True), (2, 1, "\ncc", True), (3, 2, "y\n\nz", False)],
        [(1, 3, "after the end", True), (1, 0, "after the end", True), (2, 2, "late", True), (5, 0, "whole 😀", True)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/parts")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/parts")
    got = sorted(tuple(r) for r in chunks.growing_chunks(stream, 10).collect())
    texts = {1: "ccc\n\nddd\n\neeeeeee\n\nff", 2: "aaaa\n\nbbbb\n\ncc", 5: "whole 😀"}
    want = [(k, i, *c) for k, t in texts.items() for i, c in enumerate(chunking.greedy(t, 10))]
    assert got == sorted([*want, (3, 0, 0, 1, "x" * 9)])


def test_any_batches_of_parts_give_the_chunks_of_the_whole():
    rng = random.Random(3)
    for _ in range(100):
        texts = {k: "".join(rng.choice(["a" * rng.randrange(1, 30), " ", "\n\n", "\n\n\n", "é😀 "]) for _ in range(rng.randrange(1, 40))) for k in range(4)}
        parts = [(k, i // 7, t[i : i + 7], i + 7 >= len(t)) for k, t in texts.items() for i in range(0, len(t), 7)]
        parts += rng.choices(parts, k=5)
        rng.shuffle(parts)
        held, found, some = [], [], 1 + len(parts) // 3
        for b in range(0, len(parts), some):
            rows = [(*r, True) for r in held] + [(*p, None, False) for p in parts[b : b + some]]
            rows = [r[:5] for r in sorted(rows, key=lambda r: (r[0], r[1], not r[5]))]
            out = list(chunks.grown(rows, 60))
            found += [r[:5] for r in out if r[9] == "chunk"]
            held = [(r[0], *r[5:9]) for r in out if r[9] == "held"]
        assert sorted(found) == [(k, i, *c) for k, t in texts.items() for i, c in enumerate(chunking.greedy(t, 60))]
        assert [r[1] for r in held] == [-1] * 4  # nothing of a closed document but that it is closed
        assert all(len(r[4]) < 40 for r in held)


def test_texts_do_not_go_with_their_parts(spark, tmp_path, monkeypatch):
    """a long text is cut up in time linear in it, and parts are counted in characters, not in UTF-16 units."""
    from pyspark.sql.readwriter import DataFrameWriter
    from skeinlake.plans import embedding

    texts = {1: "😀" * 1500, 2: "", 3: None, 4: "a. B\n" * 700, 5: "x" * 700}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    plans, write = [], DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        plans.append((self._df._jdf.queryExecution().optimizedPlan().toString(), path))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    got = sorted((r["doc_id"], r["begin"], r["finish"], r["characters"]) for r in embedding.growing_chunks(spark, f"file://{tmp_path}").collect())
    whole = {k: (t or "").replace(". B", ".\n\nB") for k, t in texts.items()}
    assert got == sorted((k, a, b, len(c)) for k, t in whole.items() for a, b, c in chunking.greedy(t))
    plan, path = plans[0]
    assert "regexp_extract_all" in plan and plan.count("regexp_replace") == 1
    parts = {k: [r["part"] for r in rows] for k in whole for rows in [sorted(spark.read.parquet(path).where(f"doc_id = {k}").collect(), key=lambda r: r["part_no"])]}
    assert {k: [len(p) for p in v] for k, v in parts.items()} == {k: [min(700, len(t) - i) for i in range(0, len(t), 700)] for k, t in whole.items()}


def test_held_tables_and_batches_stay_few(spark, tmp_path, monkeypatch):
    """a stream leaves the held rows of its last two batches only, and the query has four batches at most, whatever the number of files."""
    from pathlib import Path

    from pyspark.sql import DataFrame
    from skeinlake.plans import embedding

    made = []
    monkeypatch.setattr(chunks, "fresh_path", lambda _spark, name: made.append(f"{tmp_path}/{name}") or f"file://{tmp_path}/{name}")
    repartition = DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *keys: repartition(self, 23 if isinstance(n, int) else n, *keys))
    text = "\n\n".join(f"{k} " * 200 for k in range(40))
    spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert embedding.growing_chunks(spark, f"file://{tmp_path}").count() == 3 * len(chunking.greedy(text))
    out = Path(made[0]) / "out"
    assert sorted(p.name for p in out.glob("batch=*")) == [f"batch={k}" for k in range(4)]
    assert sorted(p.parent.name for p in out.glob("batch=*/kind=held")) == ["batch=2", "batch=3"]
