"""Searches for many names against plain containment."""

from __future__ import annotations

import random

import pytest

from skeinlake.operators import names
from skeinlake.session import ship


@pytest.mark.parametrize("small", [{}, {"shard_chars": 40, "broadcast_bytes": 0}, {"shard_chars": 40}])
def test_overlapping_names(spark, small):
    """Names that hold each other, of both cases, repeated, empty, null; one text with most names; null and empty texts."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abAé") for _ in range(n))
    wanted = [None, "", "a", "A", "aa", "aaa", "zz", "a b"] + [word(rng.randrange(1, 6)) for _ in range(60)]
    texts = [(k, word(rng.randrange(0, 30))) for k in range(80)] + [(100, None), (101, ""), (102, "a" * 3000 + " A B")]
    df = spark.createDataFrame(texts, "k long, t string")
    found = names.names_in(df, "k", "t", ship(spark).createDataFrame([(n,) for n in wanted], "name string"), **small)
    got = sorted((r["id"], r["name"]) for r in found.collect())
    assert got == sorted((k, n) for k, t in texts for n in {n for n in wanted if n} if t is not None and n.lower() in t.lower())


def test_hundred_thousand_names(spark):
    wanted = spark.range(100_000).selectExpr("concat('name', id, 'x') AS name")
    texts = ship(spark).createDataFrame([(1, "name5x name77777x NAME99999X name100000x")], "k long, t string")
    for limit in (64 << 20, 0):
        found = names.names_in(texts, "k", "t", wanted, shard_chars=300_000, broadcast_bytes=limit).collect()
        assert sorted(r["name"] for r in found) == ["name5x", "name77777x", "name99999x"]


def test_no_names_and_no_texts(spark):
    some, none = spark.createDataFrame([(1, "a")], "k long, t string"), spark.createDataFrame([], "name string")
    assert names.names_in(some, "k", "t", none).collect() == []
    assert names.names_in(some.where("k = 2"), "k", "t", spark.createDataFrame([("a",)], "name string")).collect() == []
