"""Viterbi over very long texts."""

from __future__ import annotations

import numpy as np

from skeinlake.llm import language_id


def test_a_million_words_are_labelled_exactly():
    """Scores are multiples of 1/64, so that whole numbers can check them."""
    rng = np.random.default_rng(2)
    n, many, penalty = 1_000_000, 4, 12
    whole = rng.integers(-900, -700, (n, many)) + 40 * (rng.integers(0, 50, n).cumsum() // 500 % many == np.arange(many)[:, None]).T
    got = language_id.viterbi((whole / 64).astype(np.float32), np.array([0, n]), penalty)
    value, came = whole[0].tolist(), []
    for row in whole[1:].tolist():
        top = max(range(many), key=value.__getitem__)
        switched = value[top] - 64 * penalty
        came.append([top if switched > v else k for k, v in enumerate(value)])
        value = [max(switched, v) + s for v, s in zip(value, row, strict=True)]
    state = max(range(many), key=value.__getitem__)
    want = [state]
    for back in reversed(came):
        state = back[state]
        want.append(state)
    assert got.tolist() == want[::-1]
    assert len(set(want)) > 1
