"""Vectors that follow from a text alone, for tests and dry runs of a pipeline: tiled digests, and seeded numbers with marks of content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: Words and signs that raise ten dimensions each, from the first, the eleventh and the twenty-first on.
MARKS = (("definition", "define"), ("example", "exercise", "problem"), ("∫", "∑", "∂", "$", "="))
RAISE = 0.5


def hash_tiled(text: Column, dimensions: int = 1536) -> Column:
    """The four numbers between -1 and 1 that the md5 digest of a text gives, over and over."""
    digest = F.md5(text)
    words = F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("double") / 4294967296.0 * 2 - 1 for k in range(4)))
    return F.slice(F.flatten(F.array_repeat(words, -(-dimensions // 4))), 1, dimensions)


def tokens(text: Column) -> Column:
    """About how many tokens a text has: 1.3 a word, 1 at least."""
    return F.greatest(F.lit(1.0), F.regexp_count(text, F.lit(r"\S+")) * 1.3).cast("int").cast("long")


def seeded(text: str, dimensions: int) -> np.ndarray:
    """A vector of length 1: normal numbers from a seed that the text's digest gives, raised where the text has marks."""
    from hashlib import md5

    numbers = np.random.RandomState(int(md5(text.encode()).hexdigest()[:8], 16)).normal(0, 1, dimensions)
    low = text.lower()
    for k, marks in enumerate(MARKS):
        if any(m in (text if k == 2 else low) for m in marks):
            numbers[10 * k : 10 * k + 10] += RAISE
    return (numbers / np.linalg.norm(numbers)).astype(np.float32)


def with_vectors(rows: DataFrame, keys: list[str], text_col: str, dimensions: int = 64) -> DataFrame:
    """Adds `vector` to keys and text; a blank or null text has none."""
    kinds = dict(rows.dtypes)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in slices(len(t or "") for t in batch[text_col]):
                some = batch.iloc[a:b]
                yield some.assign(vector=[seeded(t, dimensions) if t is not None and t.strip() else None for t in some[text_col]])

    return rows.select(*keys, text_col).mapInPandas(task, ", ".join(f"{c} {kinds[c]}" for c in (*keys, text_col)) + ", vector array<float>")
