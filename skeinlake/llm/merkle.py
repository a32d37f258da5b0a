"""Merkle manifest of a table: a tree for each group of rows, a tree over their roots, and a proof for each row.

Rows are numbered within their group by ranges of the order.  A superblock is `fanout ** levels` consecutive nodes; one
call of applyInPandas collapses a superblock by `levels` levels and keeps, for each of its nodes, the siblings that a
proof needs.  The roots of superblocks are the nodes of the next round, until each group has one node.  Going back down,
each node's lower proof is followed by the upper proof of its superblock's root.

Nulls have a form of their own ("-"), which no value has.  Rows that are equal in all columns are leaves of their own;
rows of equal ids are in the order of their leaves, null ids first.  An empty table has an empty manifest.  Other columns
of the rows are ignored, whatever their names; very long texts are hashed in the JVM and go no further.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

FANOUT = 3
#: Levels that one task collapses at once: superblocks of 729 nodes.
LEVELS = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of monotonically_increasing_id() that number the rows of a partition.
_ROW_BITS = 33


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row's values: each "-" if null, else its length in UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _reductions(n: int, fanout: int) -> int:
    count = 0
    while n > 1:
        n, count = -(-n // fanout), count + 1
    return count


def _collapse(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    from hashlib import sha256

    def task(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("idx")
        nodes, n = block["digest"].tolist(), int(block["n"].iloc[0])
        steps = levels if n > fanout**levels else _reductions(n, fanout)
        lefts: list[list[str]] = [[] for _ in nodes]
        rights: list[list[str]] = [[] for _ in nodes]
        width = 1
        for _ in range(steps):
            runs = [nodes[a : a + fanout] for a in range(0, len(nodes), fanout)]
            before = ["".join(run[:k]) for run in runs for k in range(len(run))]
            after = ["".join(run[k + 1 :]) for run in runs for k in range(len(run))]
            for k in range(len(lefts)):
                lefts[k].append(before[k // width])
                rights[k].append(after[k // width])
            nodes, width = [sha256("".join(run).encode()).hexdigest() for run in runs], width * fanout
        return block.assign(lefts=lefts, rights=rights, above=nodes[0])

    return task


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx (0, 1, ... in this order within each tree) and n, the rows of the tree.

    Rows are laid out in ranges; equal rows are told apart by where they come from, so that they need not meet.
    """
    laid = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "at").sortWithinPartitions("tree", *order).drop("at")
    laid = stage(laid.withColumn("row", F.monotonically_increasing_id()), "merkle-order")
    counts = laid.groupBy(F.shiftright("row", _ROW_BITS).alias("part"), "tree").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "tree", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"), F.sum("rows").over(tree).alias("n"))
    laid = laid.withColumn("part", F.shiftright("row", _ROW_BITS)).join(stage(counts, "merkle-counts"), ["part", "tree"])
    return laid.withColumn("idx", F.col("start") + F.col("row") - F.col("first")).drop("part", "row", "first", "start")


def _trees(rows: DataFrame, order: list[str], fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of superblocks, lowest first, and tree, subroot.  Rows have tree, digest and whatever else they carry."""
    width, rounds, tops = fanout**levels, [], None
    nodes = stage(_numbered(rows, order), "merkle-leaves")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        nodes = nodes.withColumn("block", F.floor(F.col("idx") / width).cast("long"))
        schema = ", ".join(f"`{name}` {kind}" for name, kind in nodes.dtypes) + ", lefts array<string>, rights array<string>, above string"
        done = stage(nodes.groupBy("tree", "block").applyInPandas(_collapse(fanout, levels), schema), "merkle-blocks")
        rounds.append(done)
        roots = done.where(F.col("idx") % width == 0).select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / width).cast("long").alias("n"), (F.col("n") <= width).alias("single"), F.col("above").alias("digest"))
        top = roots.where("single").select("tree", F.col("digest").alias("subroot"))
        tops = top if tops is None else tops.unionByName(top)
        if most <= width:
            return rounds, tops
        nodes, most = roots.where("NOT single").drop("single"), -(-most // width)


def _proved(rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The lowest round's rows with whole proofs.  above: tree, lefts, rights and more of each tree's root."""
    width, found = fanout**levels, None
    more = [c for c in above.columns if c not in ("tree", "lefts", "rights")]
    upper = [F.col("lefts").alias("up_lefts"), F.col("rights").alias("up_rights"), *more]
    for k in range(len(rounds) - 1, -1, -1):
        own = rounds[k]
        ends = own.where((F.col("n") <= width) & (F.col("idx") == 0)).select("tree", "block")
        parents = ends.join(above, "tree").select("tree", "block", *upper)
        if found is not None:
            parents = parents.unionByName(found.select("tree", F.col("idx").alias("block"), *upper))
        found = own.join(parents, ["tree", "block"]).withColumns({"lefts": F.concat("lefts", "up_lefts"), "rights": F.concat("rights", "up_rights")}).drop("up_lefts", "up_rights")
        if k:
            found = stage(found, "merkle-proofs")
    return found


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Adds idx, lefts, rights, subroot and root to leaves, which have group (text or null), digest and the columns of `order`.

    lefts and rights hold for each level, from the leaf up to the root, the siblings before and after the node, joined.
    A group's leaves are in this order; the groups' roots are ordered by group, null first, then by UTF-8 bytes.
    """
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "group"), F.lit("")))
    rounds, subroots = _trees(keyed, order, fanout, levels)
    subroots = stage(subroots, "merkle-subroots")
    above, roots = _trees(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("of"), F.col("subroot").alias("digest")), ["of"], fanout, levels)
    roots = roots.select("tree", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.col("subroot").alias("root"))
    proved = _proved(above, roots, fanout, levels).select(F.col("of").alias("tree"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    return _proved(rounds, stage(proved, "merkle-trees"), fanout, levels).drop("tree", "block", "n", "above")


def folded(leaf: Column, lefts: str = "lefts", rights: str = "rights") -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.arrays_zip(F.col(lefts).alias("l"), F.col(rights).alias("r")), leaf, lambda node, level: F.sha2(F.concat(level["l"], node, level["r"]), 256))


def proof_digest(lefts: str = "lefts", rights: str = "rights") -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda left, right: F.concat(left, right)), ""), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """group, doc_id and digest of documents, and tampered: the leaf without line feeds where 2 divides the crc32 of the id."""
    values = [F.col(c) for c in COLUMNS]
    cut = F.translate("text", "\n", "")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, leaf_of([*values[:-1], cut])).otherwise(leaf_of(values))
    return docs.select(F.col("source").alias("group"), "doc_id", leaf_of(values).alias("digest"), tampered.alias("tampered"))


def verified(docs: DataFrame) -> DataFrame:
    """A row for each document: its leaf, roots and proof, and whether a tampered text is still proved by it."""
    rows = manifest(document_leaves(docs), ["doc_id", "digest"])
    rows = rows.withColumn("folded_root", folded(F.col("tampered")))
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))
