"""Rounds of packing: no group takes all pieces, whatever their lengths, and sequences are as full as in one group."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skeinlake.llm import packing

KINDS = {
    "over half": lambda rng, n: rng.integers(520, 900, n),
    "thirds": lambda rng, n: np.full(n, 300),
    "half of them over half": lambda rng, n: np.where(rng.random(n) < 0.5, rng.integers(520, 900, n), rng.integers(300, 1024, n)),
    "short and long": lambda rng, n: np.minimum(rng.geometric(1 / 400, n), 1023),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_groups_stay_small(spark, tmp_path, kind):
    lengths = KINDS[kind](np.random.default_rng(7), 4000)
    pq.write_table(pa.table({"id": pa.array(range(4000)), "length": pa.array(lengths, pa.int64())}), tmp_path / "pieces.parquet")
    rows = packing.pack(spark.read.parquet(str(tmp_path / "pieces.parquet")), 1024, 400).collect()
    assert sorted((r["id"], r["length"]) for r in rows) == list(enumerate(lengths.tolist()))
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert sum(n for _, n in parts) <= 1024
    groups = Counter(-(r["sequence_id"] + 1) >> 26 for r in rows)
    assert max(groups.values()) < 2 * 400
    whole = packing.sum_of_squares(lengths, 1024)[0].max() + 1
    assert len(places) <= 1.01 * whole + 5
