"""Null ids, repeated rows, odd texts, empty tables and columns of clashing names, for each operator and stage."""

from __future__ import annotations

import public_tokenizers
import pytest

import corpus_pipeline
from skeinlake.llm import exact_dedup, language_id, line_quality, packing, personal_data, sentence_pieces, simhash, substring_dedup, token_blocks, warc

BYTE, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))

ONE_ROW_EACH = {
    "tokens": lambda d: token_blocks.read_tokens(token_blocks.write_tokens(d, WORDS, 2)),
    "substring": substring_dedup.remove_repeats,
    "pieces": lambda d: sentence_pieces.encode_table(d, PIECES),
    "personal": lambda d: personal_data.find(d, personal_data.train(d)),
    "quality": line_quality.judge,
    "language": lambda d: language_id.identify(d, language_id.train(d)),
    "exact": exact_dedup.decide,
    "near": simhash.near_duplicates,
}


@pytest.mark.parametrize("name", sorted(ONE_ROW_EACH))
def test_odd_rows_give_a_row_each(spark, odd_docs, name):
    want = sorted(r["doc_id"] or -1 for r in odd_docs.collect())
    assert sorted(r["doc_id"] or -1 for r in ONE_ROW_EACH[name](odd_docs).collect()) == want


@pytest.mark.parametrize("name", sorted(ONE_ROW_EACH))
def test_empty_table(spark, odd_docs, name):
    assert ONE_ROW_EACH[name](odd_docs.where("doc_id = -5")).collect() == []


def test_packing_of_odd_rows(spark, odd_docs):
    pieces = packing.cut_into_pieces(odd_docs, BYTE, 2)
    assert packing.pack(pieces).count() == pieces.count() >= odd_docs.count()
    assert packing.pack(packing.cut_into_pieces(odd_docs.where("doc_id = -5"), BYTE, 2)).collect() == []


def test_warc_of_odd_rows(spark, odd_docs):
    pages = odd_docs.selectExpr("doc_id AS page_id", "text AS html", "source AS url", "kept", "path")
    for rows in (pages, pages.where("page_id = -5")):
        headers = warc.write_archives(rows, "2024-01-01T00:00:00Z")
        got = warc.read_archives(warc.rewrite_archives(warc.resolve_revisits(headers), "2024-01-01T00:00:00Z"))
        assert got.count() == rows.count()


def test_stages_keep_the_columns(spark, odd_docs, sf_dir):
    docs = odd_docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, sf_dir)
        assert docs.dtypes == odd_docs.dtypes
        clashing = [c for c in odd_docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert {x for r in docs.select(clashing).collect() for x in r} <= {"mine"}
        assert function(spark, odd_docs.where("doc_id = -5"), sf_dir).collect() == []


def test_pipeline_takes_effect(spark, sf_dir, texts):
    """The stages one after the other leave what the operators say of their own inputs."""
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    kept = {r["doc_id"] for r in line_quality.judge(docs).where("kept").collect()}
    good = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    assert {r["doc_id"] for r in good.collect()} == kept
    unique = corpus_pipeline.exact_copies(spark, good, sf_dir).cache()
    assert {r["doc_id"] for r in unique.collect()} == {r["doc_id"] for r in exact_dedup.decide(good).where("kept").collect()}
    single = corpus_pipeline.near_copies(spark, unique, sf_dir).cache()
    assert {r["doc_id"] for r in single.collect()} == {r["component_id"] for r in simhash.near_duplicates(unique).collect()}
    clean = corpus_pipeline.private(spark, single, sf_dir).cache()
    assert clean.count() == single.count()
    for r in clean.collect():
        assert not personal_data.pattern_spans(r["text"])
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
