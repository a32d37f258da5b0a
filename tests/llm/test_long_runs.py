"""Very long runs without a blank, many languages, and archives that exist already."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from skeinlake.llm import language_id, sentence_pieces, warc

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("step", [50, 400])
def test_independent_parts_encode_like_the_whole(step):
    rng = random.Random(step)
    pieces = sentence_pieces._loaded(PIECES)[0]
    for _ in range(20):
        chunk = "".join(rng.choice(["the", "ing", "你好", "世", "x", "é", "ż", "Q", "zzzz", "9", "_", "🙂"]) for _ in range(300))
        parts = sentence_pieces.independent_parts(chunk, pieces, step)
        assert "".join(parts) == chunk and len(parts) > 1
        assert b"".join(sentence_pieces.encode_chunks(parts, pieces)) == sentence_pieces.encode_chunks([chunk], pieces)[0]


def test_a_run_of_a_million_characters():
    import sentencepiece

    rng = random.Random(1)
    text = "".join(rng.choice(["the", "ing", "你好", "世", "xq", "é", "Q", "9"]) for _ in range(500_000))
    ids, _ = sentence_pieces.encode(pa.array([text, "a b"]), PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert ids.tolist() == model.encode(text) + model.encode("a b")


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    scores = rng.normal(0, 3, (11, 4)).astype(np.float32)
    offsets, penalty = np.array([0, 5, 5, 11]), 2.5
    got = language_id.viterbi(scores, offsets, penalty)

    def value(path, begin):
        return sum(scores[begin + i, k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path[:-1], path[1:]))

    for a, b in ((0, 5), (5, 11)):
        every = np.array(np.meshgrid(*[range(4)] * (b - a), indexing="ij")).reshape(b - a, -1).T
        assert abs(max(value(p, a) for p in every) - value(got[a:b], a)) < 1e-4


def test_more_languages_than_a_byte_holds():
    scores = np.full((300, 200), -5.0, np.float32)
    scores[np.arange(300), 199 - np.arange(300) // 100] = 5
    assert language_id.viterbi(scores, np.array([0, 300]), 1.0).tolist() == [199 - i // 100 for i in range(300)]


def test_revisits_of_existing_archives(spark):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (3, None, "other"), (None, "http://c/", None)], "page_id long, url string, html string")
    date = "2024-01-01T00:00:00Z"
    headers = warc.write_archives(pages, date)
    assert headers.select("record_id").distinct().count() == 5
    want = sorted(warc.read_archives(paths := warc.rewrite_archives(warc.resolve_revisits(headers), date)).collect(), key=str)
    scanned = warc.scan_archives(paths)
    assert scanned.where("record_type = 'revisit'").count() == 2 and scanned.where("content_key IS NULL").count() == 0
    resolved = warc.resolve_revisits(scanned)
    again = warc.rewrite_archives(resolved, date)
    assert sorted(warc.read_archives(again).collect(), key=str) == want
    records = {r["record_id"]: r for r in warc.scan_archives(again).collect()}
    assert len(records) == 5 and not set(records) & {r["record_id"] for r in scanned.collect()}
    newer = warc.write_archives(spark.createDataFrame([(9, "http://d/", "same")], "page_id long, url string, html string"), date)
    joined = warc.resolve_revisits(scanned.unionByName(newer))
    assert {(r["page_id"], r["new_type"], r["refers_to"]) for r in joined.where("payload_bytes = 4").collect()} == {(9, "response", None), (1, "revisit", 9), (2, "revisit", 9)}
