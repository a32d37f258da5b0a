"""Boilerplate lines, kept and removed, against brute force over whole texts of a host."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import test_edges
import test_operators
from skeinlake.llm import line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(line):
    return re.sub("[0-9]+", "0", " ".join(WORD.findall(line)).lower())


def brute_force(rows, documents=50, share=0.005):
    """id -> (kept, text without boilerplate), of rows (id, host, text) without repeated windows of words."""
    texts, having = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        texts[host].add(text)
        for line in text.split("\n"):
            having[host, normal(line)].add(text)
    bad = {k for k, v in having.items() if k[1] and len(v) > documents and len(v) > share * len(texts[k[0]])}
    out = {}
    for doc, host, text in rows:
        stays = [line for line in text.split("\n") if (host, normal(line)) not in bad]
        words, left = len(WORD.findall(text)), sum(len(WORD.findall(x)) for x in stays)
        out[doc] = (words >= 20 and left >= 0.3 * words, "\n".join(stays))
    return out


def letters(n):
    return "".join(chr(97 + int(c)) for c in str(n))


def lines_of(name, n, words=5):
    return [" ".join(f"{name}{letters(k)}{letters(w)}" for w in range(words)) for k in range(n)]


def judged(spark, tmp_path, rows):
    path = str(tmp_path / "rows.parquet")
    ids, hosts, texts = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "source": pa.array(hosts, pa.string()), "text": pa.array(texts, pa.string())}), path)
    got = line_quality.judge(spark.read.parquet(path), with_text=True).collect()
    assert len(got) == len(rows)
    return {r["doc_id"]: (r["kept"], r["_text"]) for r in got}


def many_shared_lines(host, first):
    """Pages of many shared and few own lines, and pages of the same host with enough own lines."""
    rows = []
    for i in range(300):
        own = lines_of(f"own{letters(i)}x", 2 if i % 3 else 20)
        rows.append((first + i, host, "\n".join([*lines_of("menu", 20), *own])))
    return rows


def test_many_shared_and_few_own_lines(spark, tmp_path):
    rows = many_shared_lines("a", 0) + [(1000 + i, "b", "\n".join(lines_of(f"other{letters(i)}x", 6))) for i in range(100)]
    want = brute_force(rows)
    assert sum(kept for kept, _ in want.values()) == 200
    assert judged(spark, tmp_path, rows) == want


def test_copies_count_once(spark, tmp_path):
    """A footer on 400 different pages stays boilerplate beside 1,000 copies of one page, which share it or do not."""
    rows = []
    for host, footer in (("a", lines_of("footer", 1)), ("b", [])):
        page = "\n".join([*lines_of(f"page{host}x", 6), *footer])
        rows += [(len(rows) + i, host, page) for i in range(1000)]
        rows += [(len(rows) + i, host, "\n".join([*lines_of(f"own{letters(i)}x", 6), *lines_of("footer", 1)])) for i in range(400)]
    # Copies must not weigh in the host's share either: 60 of 12,560 documents are 61 distinct ones at most.
    rows += [(len(rows) + i, "c", "\n".join(lines_of("pagec", 6))) for i in range(12_500)]
    rows += [(len(rows) + i, "c", "\n".join([*lines_of(f"own{letters(i)}x", 6), *lines_of("footer", 1)])) for i in range(60)]
    want = brute_force(rows)
    assert sum("footer" in text for _, text in want.values()) == 0
    assert judged(spark, tmp_path, rows) == want


@pytest.fixture
def joined(monkeypatch):
    """Boilerplate lines are joined to their documents, however few there are."""
    monkeypatch.setattr(line_quality, "BROADCAST_LINES", -1)


def test_joined_lines_of_a_null_host(spark, tmp_path, joined):
    rows = many_shared_lines(None, 0) + many_shared_lines("a", 1000)
    want = brute_force(rows)
    assert sum(kept for kept, _ in want.values()) == 200
    assert judged(spark, tmp_path, rows) == want


def test_joined_lines_of_odd_rows(spark, sf_dir, texts, odd_docs, joined):
    test_operators.test_op6_line_quality(spark, sf_dir, texts)
    test_edges.test_odd_rows_give_a_row_each(spark, odd_docs, "quality")
    test_edges.test_empty_table(spark, odd_docs, "quality")
    kept = line_quality.keep_good(odd_docs)
    assert kept.dtypes == odd_docs.dtypes
    assert {r[c] for r in kept.collect() for c in ("uid", "_c0", "host", "line", "kept")} == {"mine"}
