"""The patterns against Python's own, the tagger's gradients, and what the tagger finds that the patterns miss."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_operators import base_spans

from skeinlake.llm import personal_data as pd_
from skeinlake.llm.char_tagger import CLASSES, Tagger

DOCS = "/root/testdata/sf0.1/documents.parquet"
HIDDEN = {
    "email": "write to jo.sand at mail7 dot example dot com please",
    "ip": "the host 10[.]20[.]30[.]41 was seen",
    "card": "paid with 4111.1111.1111.1111 today",
    "phone": "call (323) 555-9830 at noon",
}


def test_patterns_against_regular_expressions():
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", "x@y.z", "1", "23", "255", "300", ".", "..", "-", " ", "+", "+4", "(", ")", "%", "4111 1111 1111 1111", "1.2.3.4", "é", "\n", "a@b.com@d.org", "+1 (323) 555-9830", "1.2.3.4.5.6.7.8"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        want = [(pd_.KINDS.index(k), a, b) for k, a, b in base_spans(text)]
        assert pd_.pattern_spans(text) == want, text


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 1_000_000 + "@", "1." * 500_000, "+1" * 400_000, "a@" * 400_000, "+1" + "(" * 1_000_000, "a.b-" * 250_000 + "@x"])
def test_very_long_texts_take_seconds(text):
    begin = time.perf_counter()
    pd_.pattern_spans(text)
    assert time.perf_counter() - begin < 10


def test_gradients():
    rng = np.random.default_rng(1)
    t = Tagger(5, hidden=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = rng.integers(0, CLASSES, (4, 6)).astype(np.uint8), rng.integers(0, 5, (4, 6))
    _, g = t.gradients(x, y)
    for name, grad in g.items():
        for place in rng.permutation(grad.size)[:40]:
            at = np.unravel_index(place, grad.shape)
            old, values = t.p[name][at], []
            for d in (1e-2, -1e-2):
                t.p[name][at] = old + d
                values.append(t.gradients(x, y)[0])
            t.p[name][at] = old
            assert abs((values[0] - values[1]) / 2e-2 - grad[at]) < 2e-3, (name, at)


def test_marginals_against_all_taggings():
    t = Tagger(3, hidden=2)
    x = np.random.default_rng(2).integers(0, CLASSES, (1, 5)).astype(np.uint8)
    e = (t._states(x) @ t.p["out"] + t.p["bias"])[:, 0].astype(np.float64)
    every = np.array(np.meshgrid(*[range(3)] * 5, indexing="ij")).reshape(5, -1)
    score = t.p["first"][every[0]] + sum(e[i, every[i]] for i in range(5)) + sum(t.p["step"][every[i], every[i + 1]] for i in range(4))
    weight = np.exp(score - score.max())
    best = t.best(t.scores(x)[0], np.array([0, 5]))[None, :]
    sure = np.take_along_axis(t.marginals(t.scores(x)), best[:, :, None].astype(np.int64), 2)[:, :, 0]
    assert best[0].tolist() == every[:, score.argmax()].tolist()
    if best.any():
        for i in range(5):
            assert abs(weight[every[i] == best[0, i]].sum() / weight.sum() - sure[0, i]) < 1e-4


@pytest.fixture(scope="module")
def tagger(spark):
    return pd_.train(spark.read.parquet(DOCS).where("doc_id % 3 <> 0"))


def held_out():
    rows = pq.read_table(DOCS, columns=["doc_id", "text"]).to_pylist()
    return [r["text"] for r in rows if r["doc_id"] % 3 == 0 and r["text"]]


def test_held_out_spans_are_found(tagger):
    texts = held_out()
    found, want = np.zeros(4), np.zeros(4)
    for text, spans in zip(texts, pd_.tagger_spans(texts, tagger), strict=True):
        for span in pd_.pattern_spans(text):
            want[span[0]] += 1
            found[span[0]] += span in spans
    assert (want >= 5).all() and (found >= 0.9 * want).all(), (found, want)


def test_respelled_spans_are_found(tagger):
    rng, found, want = np.random.default_rng(3), np.zeros(4), np.zeros(4)
    for text in held_out():
        spans = pd_.pattern_spans(text)
        for k, a, b in spans[:1]:
            pieces = pd_.respell(pd_.KINDS[k], text[a:b], rng)
            if len(pieces) > 1:
                continue
            new = text[:a] + pieces[0][1] + text[b:]
            want[k] += 1
            found[k] += (k, a, a + len(pieces[0][1])) in pd_.tagger_spans([new], tagger)[0]
    assert (want >= 5).all() and found.sum() >= 0.85 * want.sum(), (found, want)


def test_spans_are_added_that_patterns_miss(spark, tagger, tmp_path):
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(HIDDEN.values())], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pd_.find(docs, tagger).collect()}
    assert all(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == 0 for r in rows.values())
    hits = [kind for k, kind in enumerate(HIDDEN) if rows[k]["spans"].startswith(kind)]
    assert len(hits) == 4, {k: r["spans"] for k, r in rows.items()}
    redacted = {r["doc_id"]: r["text"] for r in pd_.find(docs, tagger, redact=True).collect()}
    assert all(f"<{kind.upper()}>" in redacted[list(HIDDEN).index(kind)] for kind in hits)


def test_hardly_anything_is_added_to_clean_texts(tagger):
    texts = [t for t in held_out() if not pd_.pattern_spans(t) and "token = " not in t.lower()]
    assert len(texts) > 100
    assert sum(len(s) for s in pd_.tagger_spans(texts, tagger)) <= len(texts) // 100


def test_runs_are_decoded_as_chains(tagger, monkeypatch):
    """A zone of many windows has the tags of one chain over its scores, also where it is decoded in stretches; runs do not touch each other."""
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(["a1", " 4111 1111", "@b.de ", "+49 30 12345678 ", "10.1.2.3 "]) for _ in range(700))
    x, starts = pd_.windows_of(text)
    assert set(np.diff(starts)) == {pd_.WINDOW // 2}
    e = tagger.scores(x)
    quarter = pd_.WINDOW // 4
    flat = np.concatenate([w[0 if k == 0 else quarter : pd_.WINDOW if k == len(e) - 1 else 3 * quarter] for k, w in enumerate(e)])[: len(text)]
    value, came = flat[0].astype(float) + tagger.p["first"], []
    for row in flat[1:]:
        reach = value[:, None] + tagger.p["step"]
        came.append(reach.argmax(axis=0))
        value = reach.max(axis=0) + row
    state = [int(value.argmax())]
    for back in reversed(came):
        state.append(int(back[state[-1]]))
    want = np.array(state[::-1])
    assert want.any() and (tagger.best(flat, np.array([0, len(flat)])) == want).all()
    two = tagger.best(np.concatenate([flat, flat[:50]]), np.array([0, len(flat), len(flat), len(flat) + 50]))
    assert (two[: len(flat)] == want).all() and (two[len(flat) :] == tagger.best(flat[:50], np.array([0, 50]))).all()
    whole = pd_.tagger_spans([text, "none", text], tagger)
    monkeypatch.setattr(pd_, "STRETCH", 16)
    monkeypatch.setattr(pd_, "WINDOWS_AT_ONCE", 32)
    assert pd_.tagger_spans([text, "none", text], tagger) == whole and whole[0] == whole[2] and whole[1] == []


def test_dense_texts_take_linear_time(tagger):
    """Two megabytes of digits in the tagger, and a list of 100,000 addresses in training."""
    begin = time.perf_counter()
    pd_.tagger_spans(["0123456789 " * 50_000], tagger)
    half = time.perf_counter() - begin
    begin = time.perf_counter()
    pd_.tagger_spans(["0123456789 " * 100_000], tagger)
    assert time.perf_counter() - begin < 3 * half + 5
    begin = time.perf_counter()
    pd_.training_windows("".join(f"user{k}@example{k % 97}.org, " for k in range(100_000)))
    assert time.perf_counter() - begin < 60
