"""The conversation trie against a dictionary of prefixes, with small runs, families and rounds."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from skeinlake.llm import conversation_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild=True):
    own = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        if r[0] is not None:
            own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = sum(saved[q] for q in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        if p:
            kids.setdefault(p[:-1], []).append(p)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], digest(ends.get(p, []))) for p, m in members.items()), key=str)


def built(turns, rebuild=True, **small):
    rows = trie.sequences(turns)
    rows = trie.with_shared_heads(rows) if rebuild else rows
    return sorted((tuple(r) for r in trie.trie(rows, **small).select(*COLUMNS).collect()), key=str)


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("small", [{}, {"run_bytes": 2000, "family": 2, "fan_in": 3}, {"run_bytes": 500, "family": 1, "fan_in": 2}])
def test_rebuilt_conversations(spark, many_ranges, small):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert built(turns, **small) == brute([tuple(r) for r in turns.collect()])


def test_copies_hot_first_turns_and_long_conversations(spark, many_ranges):
    rnd = random.Random(3)
    rows = []
    for c in range(400):
        turns = ["hello"] * (c % 2) + [rnd.choice("abc") for _ in range(rnd.randrange(5))] if c % 3 else ["copy"] * 4
        turns = [str(k % 7) for k in range(1500 + c % 5)] if c > 395 else turns
        rows += [(c, k, "user" if k % 2 else None, t if t != "c" else None) for k, t in enumerate(turns)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for rebuild in (True, False):
        assert built(turns, rebuild, run_bytes=3000, family=5, fan_in=3) == brute(rows, rebuild)


def test_odd_rows_and_empty_tables(spark):
    rows = [(5, None, None, None), (5, 0, "user", "x" * 100_000), (5, 0, "user", "x" * 100_000), (7, 1, "", "🙂é"), (None, 1, "user", "lost"), (9, 1, None, "🙂é"), (300, 4, "a", "b")]
    turns = spark.createDataFrame(rows, SCHEMA)
    clash = turns
    for name in ("seq", "n", "key", "part", "side", "depth", "head", "base", "h", "first", "ids", "hash"):
        clash = clash.withColumn(name, trie.F.lit("mine"))
    for rebuild in (True, False):
        assert built(turns, rebuild) == built(clash, rebuild) == brute(rows, rebuild)
    assert built(turns.where("conv_id = -1")) == []


def test_merge_of_runs():
    rnd = random.Random(5)
    for k in range(1, 9):
        rows = [(b"".join(rnd.choice([b"a", b"b"]) * trie.RECORD for _ in range(rnd.randrange(6))), i) for i in range(60)]
        merged = list(trie.merged([trie.sorted_run(rows[j::k]) for j in range(k)]))
        assert [r[0] for r in merged] == sorted(r[0] for r in rows)
        assert [r[1] for r in merged] == [0, *(trie.common_turns(a[0], b[0]) for a, b in zip(merged, merged[1:], strict=False))]
    assert list(trie.merged([])) == []
