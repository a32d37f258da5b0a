"""Exact deduplication where digests collide, and over several loads."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from skeinlake.llm import exact_dedup

SCHEMA = "doc_id long, text string, uid string"


def rows_of(n, kinds, first=0):
    return [(first + i, ("text  %d\n" if i % 5 == 0 else "text %d") % (i * i % kinds) if i % 11 else None, "mine") for i in range(n)]


def brute(rows, seen=()):
    groups = defaultdict(list)
    for doc, text, _ in [*seen, *rows]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc))
    own = {doc for doc, _, _ in rows}
    return sorted((doc, min(some)[1], len(some), doc == min(some)[1]) for some in groups.values() for _, doc in some if doc in own)


def result(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("chars", [1, 2, 64])
def test_equal_digests_of_different_texts(spark, chars):
    rows = rows_of(300, 40)
    assert result(exact_dedup.decide(spark.createDataFrame(rows, SCHEMA), chars=chars)) == brute(rows)


@pytest.mark.parametrize("chars", [1, 64])
def test_later_loads_are_held_against_earlier_ones(spark, tmp_path, chars):
    folder, seen = f"file://{tmp_path}/kept", []
    for k, n in enumerate((120, 0, 90)):
        rows = rows_of(n, 60 + k, 1000 * (3 - k))  # later loads have smaller ids and displace rows
        df = spark.createDataFrame(rows, SCHEMA)
        assert result(exact_dedup.decide(df, folder=folder, load=f"day{k}", chars=chars)) == brute(rows, seen)
        seen += rows
    # A load that is repeated under its name does not count twice.
    again = exact_dedup.decide(df, folder=folder, load="day2", chars=chars)
    assert result(again) == brute(rows, seen[: -len(rows)])


def test_rows_that_stay_have_all_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5), (2, "ab", "y", 6), (3, None, "z", 7), (4, " ", "w", 8)], "doc_id long, text string, uid string, _uid int")
    assert sorted(map(tuple, exact_dedup.deduplicate(df).collect())) == [(1, "a b", "x", 5), (4, " ", "w", 8)]
