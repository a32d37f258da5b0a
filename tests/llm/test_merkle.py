"""The Merkle manifest against plain Python, with small and large superblocks."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from skeinlake.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, cut=False):
    values = [row[c] for c in merkle.COLUMNS]
    if cut and values[-1] is not None:
        values[-1] = values[-1].replace("\n", "")
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and the (left, right) siblings of each node by level."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, above_owners = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k in range(len(run)):
                for i in owners[a + k]:
                    proofs[i].append((run[:k], run[k + 1 :]))
            above.append(digest(*run))
            above_owners.append(sum(owners[a : a + 3], []))
        nodes, owners = above, above_owners
    return nodes[0], proofs


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for r, below in zip(groups[s], trees[s][1], strict=True):
            node = leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0)
            for left, right in below + above:
                node = digest(*left, node, *right)
            siblings = [x for left, right in below + above for x in left + right]
            out.append((r["doc_id"], leaf(r), trees[s][0], root, digest(*siblings), node, node == root))
    return sorted(out, key=str)


def built(docs, levels):
    rows = merkle.manifest(merkle.document_leaves(docs), ["doc_id", "digest"], levels=levels).withColumn("folded", merkle.folded(merkle.F.col("tampered")))
    rows = rows.select("doc_id", "digest", "subroot", "root", merkle.proof_digest(), "folded", merkle.F.col("folded") == merkle.F.col("root"))
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_is_the_plain_tree(spark, sf_dir, levels):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    assert built(docs, levels) == brute([r.asDict() for r in docs.collect()])


def test_odd_rows_many_sources_and_empty_tables(spark, odd_docs):
    """Null ids, equal rows, null and odd sources, one row in a source, clashing names of other columns."""
    docs = odd_docs.withColumn("source", merkle.F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN concat('s', doc_id) ELSE 'é' END"))
    for name in ("tree", "block", "idx", "n", "digest", "lefts", "rights", "above", "group", "row", "part"):
        docs = docs.withColumn(name, merkle.F.lit("mine"))
    got = sorted((tuple(r) for r in merkle.verified(docs).collect()), key=str)
    assert got == brute([r.asDict() for r in docs.collect()])
    assert merkle.verified(docs.where("doc_id = -5")).collect() == []
    one = docs.where("doc_id = 10003")
    assert [r["root"] == r["leaf"] for r in one.transform(merkle.verified).collect()] == [True]


def test_a_changed_text_is_found(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    for r in merkle.verified(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (r["text"] or "")
        assert r["verified"] != changed
