"""The entropy of vectors reads their bounds once, and odd vectors keep their results."""

from __future__ import annotations

import math
import time

import numpy as np

from pyspark.sql import functions as F

from skeinlake.functions import quality


def test_entropy_of_long_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=20_000).tolist(), rng.normal(size=7).tolist(), [0.5, 0.5, 0.5], [1.0], [], None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "k long, v array<double>")
    begin = time.monotonic()
    got = dict(rows.select("k", quality.entropy(F.col("v"))).collect())
    assert time.monotonic() - begin < 20  # looking for the bounds of each value again takes minutes
    for k in (0, 1):
        density, _ = np.histogram(vectors[k], bins=50, density=True)
        assert math.isclose(got[k], -sum(d * math.log2(d) for d in density if d > 0), rel_tol=1e-6)
    assert [got[k] for k in (2, 3, 4, 5)] == [0.0] * 4
