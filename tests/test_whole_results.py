"""Queries beyond SQL: all their rows on the smallest tables against plain Python."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from skeinlake.functions import prose
from skeinlake.operators import chunking, text_index
from skeinlake.plans.structure import books

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def run(spark, name):
    return entry.queries()[name](spark, DATA).collect()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def covers(chunks, length):
    """Begins and ends follow each other from the first character to the last."""
    return chunks[0][0] == 0 and chunks[-1][1] == length and all(a[1] == b[0] for a, b in zip(chunks, chunks[1:], strict=False))


def by_key(rows, *keys):
    out = {}
    for r in sorted(rows, key=lambda r: r["chunk_no"]):
        out.setdefault(tuple(r[k] for k in keys), []).append((r["begin"], r["finish"], r["digest"]))
    return out


def test_sentence_chunks(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r[0]: r[1] or "" for r in rows.select("doc_id", prose.chunk_clean(rows.text, 3)).collect()}
    got = by_key(run(spark, "sentence_chunks"), "doc_id")
    want = {(k,): [(a, b, md5(c)) for a, b, c in chunking.by_sentences(t)] for k, t in texts.items()}
    assert got == {k: v for k, v in want.items() if v}
    assert all(covers(v, len(texts[k[0]])) for k, v in got.items())


def test_section_chunks(spark):
    sections = {(r["book_id"], r["section"]): r["text"] for r in chunking.sections(books(spark, DATA)).collect()}
    got = by_key(run(spark, "section_chunks"), "book_id", "section")
    assert got == {k: [(a, b, md5(c)) for a, b, c in chunking.by_structure(t or "")] for k, t in sections.items() if (t or "").strip()}
    assert all(covers(v, len(sections[k])) for k, v in got.items() if len(sections[k].strip()) >= chunking.BY_STRUCTURE[1])


def test_region_kinds(spark):
    sections = {(r["book_id"], r["section"]): r["text"] for r in chunking.sections(books(spark, DATA)).collect()}
    got = {(r["book_id"], r["section"], r["chunk_no"]): tuple(r)[3:] for r in run(spark, "region_kinds")}
    names, want = ((1, "math"), (2, "definition"), (4, "example")), {}
    for key, text in sections.items():
        if not (text or "").strip():
            continue
        small = len(text.strip()) < chunking.BY_STRUCTURE[1]
        regions = [] if small else chunking.protected_kinds(text)
        for n, (a, b, chunk) in enumerate(chunking.by_structure(text)):
            near, first = ([k for x, y, k in regions if x < end and y > begin] for begin, end in ((a, b), (0, len(chunk))))
            told = [next((next(name for bit, name in names if k & bit) for k in some if k), "text") for some in (near, first)]
            want[(*key, n)] = (a, b, *told, len(near))
    assert got == want
    assert len({v[2] for v in got.values()}) > 1


def test_book_chunks(spark):
    """Each book in one way; its chunks are those of the plain cutter in order, but for those that are not valid."""
    rows = {}
    for r in run(spark, "book_chunks"):
        rows.setdefault(r["book_id"], []).append(r)
    every = books(spark, DATA)
    cleaned = every.where("text IS NOT NULL").select("book_id", prose.chunk_clean(every.text, 5).alias("text"))
    texts = {r["book_id"]: r["text"] for r in cleaned.collect()}
    sections = {}
    for r in chunking.sections(cleaned).orderBy("book_id", "section").collect():
        sections.setdefault(r["book_id"], []).append(r["text"] or "")
    left_out = []
    for book, text in texts.items():
        own = sorted(rows.get(book, []), key=lambda r: r["chunk_no"])
        assert [r["chunk_no"] for r in own] == list(range(len(own))) and len({r["way"] for r in own}) <= 1
        aware = bool(own) and own[0]["way"] == "content_aware"
        plain = [c for t in sections[book] for _, _, c in chunking.by_structure(t)] if aware else [c for _, _, c in chunking.by_sentences(text)]
        wanted = iter([r["digest"] for r in own])
        now = next(wanted, None)
        for chunk in plain:
            if md5(chunk) == now:
                now = next(wanted, None)
            elif own:
                left_out.append((chunk, aware))
        assert now is None, book
    gone = spark.createDataFrame(left_out, "chunk string, aware boolean")
    kind = prose.kind_of_chunk(gone.chunk)
    for aware in (True, False):
        sure = prose.confidence(gone.chunk, kind, aware)
        assert gone.where(gone.aware == aware).where(prose.is_valid_chunk(gone.chunk, sure)).count() == 0
    assert len(rows) >= 0.5 * len(texts)


def test_clean_texts(spark, docs):
    def clean(t):
        t = t.translate(str.maketrans("‘’“”–— ", "''\"\"-- "))
        t = re.sub(r"(?m)^[ \t]*(Page[ \t]+)?[0-9]+[ \t]*$", "", t)
        t = re.sub(r"([a-z])([.!?])([A-Z])", r"\1\2 \3", re.sub(r"[ \t]+", " ", t))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", t)).strip(" ")

    rows = {r["doc_id"]: r for r in run(spark, "clean_texts")}
    assert rows.keys() == docs.keys()
    plain = {k: t for k, t in docs.items() if t and not re.search("[\r\u0085  ]", t)}
    assert len(plain) >= 0.9 * len(docs)
    for k, t in plain.items():
        assert rows[k]["clean_text"] == clean(t)
        assert abs(rows[k]["left_share"] - len(clean(t)) / len(t)) <= 0.00006


def test_ivf_nearest(spark):
    table = pq.read_table(f"{DATA}/embeddings.parquet").to_pydict()
    ids, matrix = np.array(table["vec_id"]), np.array(table["embedding"], np.float64)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    rows, hits = run(spark, "ivf_nearest"), 0
    asked = [k for k in ids.tolist() if k % 100 == 0]
    for k in asked:
        score = matrix @ matrix[ids == k][0]
        own = {r["id"]: r["score"] for r in rows if r["query_id"] == k}
        assert len(own) == 10 and all(abs(s - score[ids == i][0]) < 1e-5 for i, s in own.items())
        hits += len(own.keys() & {i for i in ids[np.argsort(-score)][:11].tolist() if i != k})
    assert hits >= 9 * len(asked) and {round(r["recall"], 9) for r in rows} == {round(hits / (10 * len(asked)), 9)}


def ranked(docs, words, k):
    terms = list(text_index.places_of(words or ""))
    found = []
    for i, text in docs.items():
        places = text_index.places_of(text or "")
        if terms and all(t in places for t in terms):
            found.append((-round(text_index.rank([places[t] for t in terms]), 6), i))
    return [(n, i, -r) for n, (r, i) in enumerate(sorted(found)[:k], 1)]


def test_ranked_text_search(spark, docs):
    assert sorted(tuple(r) for r in run(spark, "ranked_text_search")) == ranked(docs, "the nicht die", 20)


def test_bulk_text_search(spark, docs):
    got = {}
    for r in run(spark, "bulk_text_search"):
        got.setdefault(r["query_id"], []).append((r["place"], r["id"], r["rank"]) if r["error"] is None else r["error"])
    for k, text in docs.items():
        if k % 100 == 0:
            words = (text or "")[:40]
            assert sorted(got.get(k, [])) == (ranked(docs, words, 3) if text_index.places_of(words) else ["no words to search for"])


def test_mock_vectors(spark, docs):
    for r in run(spark, "mock_vectors"):
        text = docs[r["doc_id"]]
        if not text or not text.strip():
            assert r["vector"] is None
            continue
        np.random.seed(int(md5(text)[:8], 16))
        want = np.random.normal(0, 1, 64)
        want[0:10] += 0.5 * ("defin" in text.lower() and any(w in text.lower() for w in ("definition", "define")))
        want[10:20] += 0.5 * any(w in text.lower() for w in ("example", "exercise", "problem"))
        want[20:30] += 0.5 * any(w in text for w in "∫∑∂$=")
        assert r["vector"] == (want / np.linalg.norm(want)).astype(np.float32).tolist()
        assert r["tokens"] == int(max(1, len(re.findall(r"[^\x20\x09-\x0D]+", text)) * 1.3))


def test_embedding_pipeline(spark, docs):
    rows = {r["doc_id"]: r for r in run(spark, "embedding_pipeline")}
    assert rows == {r["doc_id"]: r for r in run(spark, "embedding_pipeline")}
    for k, text in docs.items():
        chunks = chunking.greedy(re.sub(r"([.!?]) ([A-Z])", r"\1\n\n\2", text or ""))
        if not chunks:
            assert k not in rows
            continue
        r = rows[k]
        assert r["chunks"] == len(chunks) == r["failed"] + r["filtered"] + r["kept"] and r["embedded"] == len(chunks) and 0 <= r["mean_quality"] <= 1
        assert sum(int(g.split(":")[1]) for g in r["grades"].split(",")) == r["embedded"]


def test_normalised_texts(spark, docs):
    plain = str.maketrans("‘’“”–— ", "''\"\"-- ")
    got = {r["doc_id"]: r["text"] for r in run(spark, "normalised_texts")}
    assert got == {k: t and unicodedata.normalize("NFKC", t.translate(plain).replace("…", "...")) for k, t in docs.items()}
    odd = spark.createDataFrame([(1, "ﬁve ① ｘ é “q” …"), (2, None), (3, "")], "doc_id long, text string")
    from skeinlake.plans.expansion import normal_form

    assert [r["text"] for r in normal_form(odd, ["doc_id"], "text").orderBy("doc_id").collect()] == ['five 1 x é "q" ...', None, ""]


def test_every_query_is_tested():
    """What has no SQL has a test here."""
    plain = set(k for k in entry.queries() if not k.startswith("op") and k != "pipeline") - set(entry.oracle_sql())
    assert {f"test_{name}" for name in plain} <= globals().keys()
