"""Repeated passages where window hashes collide, and where ids repeat."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from test_operators import WORD, sha

from skeinlake.llm import substring_dedup


def texts_of(n, seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        out.append("\n".join(parts) if rng.random() < 0.9 else None)
    return out


def brute(rows):
    seen, out = set(), []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        out.append((doc, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone, strict=True) if not g))))
    return out


@pytest.mark.parametrize("keep", [4, 9, 64])
def test_equal_hashes_of_different_windows(spark, keep):
    rows = list(enumerate(texts_of(120, keep)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(df, keep=keep).collect())
    assert got == brute(rows)


def test_rows_of_one_id_give_the_same_at_each_run(spark):
    rows = [(7, t) for t in texts_of(40, 1)]
    runs = [Counter(tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(k)).collect()) for k in (1, 4, 7)]
    assert runs[0] == runs[1] == runs[2]
