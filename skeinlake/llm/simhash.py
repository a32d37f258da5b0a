"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries.

Fingerprints within k bits agree in one of k + 1 stretches of their bits.  Each distinct fingerprint goes to a group for
each of its stretches; in a group, pairs of trie nodes are traversed together from the root, differing
bits add up, and pairs over the budget are dropped.  A group gives a spanning forest of its links, not all pairs.
Groups that are too large are divided by the stretches of their remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, offsets_of, slices, small_batches, stage, strings, table, words_of

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Larger groups are divided; after the last level a group's members differ in about 20 bits only.
GROUP_LIMIT = 4096
LEVELS = 3
#: Rows of groups that meet in one task.
TASK_ROWS = 20_000
#: Node pairs that are expanded at a time, and products of node sizes that are compared outright.
PAIRS_AT_ONCE = 1 << 20
LEAF = 32


def fingerprints_of(texts: pa.Array, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints of texts; 0 for texts without words."""
    from xxhash import xxh64_intdigest

    words, offsets = words_of(pc.ascii_lower(strings(texts)))
    counts = np.diff(offsets)
    data = " ".join(words.to_pylist()).encode()
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(shingles)
    if not len(some):
        return out
    place = offsets_of(shingles[some])
    first = np.arange(place[-1]) + np.repeat(offsets[some] - place[:-1], shingles[some])
    last = np.minimum(first + width, np.repeat(offsets[some + 1], shingles[some])) - 1
    hashes = np.fromiter((xxh64_intdigest(data[a:b], SEED) for a, b in zip(begins[first].tolist(), ends[last].tolist(), strict=True)), "<u8", len(first))
    for cut in np.array_split(np.arange(len(some)), max(1, len(hashes) // 200_000)):
        if len(cut):
            lo, hi = place[cut[0]], place[cut[-1] + 1]
            bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, place[cut] - lo, axis=0, dtype=np.int32)
            out[some[cut]] = np.packbits(2 * ones > shingles[some[cut], None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None) -> DataFrame:
    """uid, doc_id and fp (signed) of each row.  Null texts have no words; a row's other columns are ignored."""
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            fp = fingerprints_of(batch.column(2)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["uid", "doc_id", "fp"])

    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(rows.mapInArrow(task, "uid long, doc_id long, fp long"), "fingerprints")


def _halves(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where, in each range of sorted fingerprints that agree above `bit`, those with the bit set begin."""
    ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
    return hi - (ones[hi] - ones[lo])


class _Forest:
    """Labels of members that links join."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            if not (differ := x != y).any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def trie_forest(fps: np.ndarray, group: np.ndarray, budget: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Joins the tries of groups with themselves: pairs of (member, its component's first member), roots left out.

    fps: distinct unsigned fingerprints in each group, sorted by group, then fingerprint.
    """
    n = len(fps)
    forest = _Forest(n)
    if n:
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        ends = np.append(starts[1:], n)
        many = ends - starts > 1
        zero = np.zeros(many.sum(), np.int64)
        work = [(63, starts[many], ends[many], starts[many], ends[many], zero)]
        while work:
            bit, al, ah, bl, bh, errors = work.pop()
            if len(al) > PAIRS_AT_ONCE:
                half = len(al) // 2
                work += [(bit, *(x[half:] for x in (al, ah, bl, bh, errors))), (bit, *(x[:half] for x in (al, ah, bl, bh, errors)))]
                continue
            small = (ah - al) * (bh - bl) <= LEAF
            if small.any() or bit < 0:
                small |= bit < 0
                _compare(fps, al[small], ah[small], bl[small], bh[small], budget, forest)
                al, ah, bl, bh, errors = (x[~small] for x in (al, ah, bl, bh, errors))
            if not len(al):
                continue
            am, bm = _halves(fps, al, ah, bit), _halves(fps, bl, bh, bit)
            same = al == bl  # a node with itself: its two children meet once
            parts = [(al, am, bl, bm, errors), (am, ah, bm, bh, errors), (al, am, bm, bh, errors + 1)]
            parts.append(tuple(x[~same] for x in (am, ah, bl, bm, errors + 1)))
            joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
            keep = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= budget)
            keep &= ~((joined[0] == joined[2]) & (joined[1] - joined[0] == 1))
            work.append((bit - 1, *(x[keep] for x in joined)))
    roots = forest.label
    member = np.flatnonzero(roots != np.arange(n))
    return member, roots[member]


def _compare(fps: np.ndarray, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, budget: int, forest: _Forest) -> None:
    """Links within the budget between the members of small nodes."""
    sizes = (ah - al) * (bh - bl)
    at = offsets_of(sizes)
    for cut in np.array_split(np.arange(len(sizes)), at[-1] // PAIRS_AT_ONCE + 1):
        rep = np.repeat(cut, sizes[cut])
        k = np.arange(len(rep)) - np.repeat(at[cut] - (at[cut[0]] if len(cut) else 0), sizes[cut])
        a, b = al[rep] + k // (bh - bl)[rep], bl[rep] + k % (bh - bl)[rep]
        near = (np.bitwise_count(fps[a] ^ fps[b]) <= budget) & (a != b)
        forest.join(a[near], b[near])


def _masks(fixed: int, parts: int) -> list[int]:
    """Masks with one more stretch of the free bits fixed, of `parts` about equal ones."""
    free = [b for b in range(64) if not fixed >> b & 1]
    return [fixed | sum(1 << int(b) for b in cut) for cut in np.array_split(free, parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`, enough of them to connect all within `budget` bits."""
    parts, found = budget + 1, None
    divide = {0: _masks(0, parts)}
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    count = distinct.count()

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, mask = pdf["fp"].to_numpy().view(np.uint64), pdf["mask"].to_numpy().view(np.uint64)
        order = np.lexsort((fps, fps & mask, mask))
        fps, mask = fps[order], mask[order]
        group = np.cumsum(np.concatenate(([0], ((fps & mask)[1:] != (fps & mask)[:-1]) | (mask[1:] != mask[:-1]))).astype(np.int64)) if len(fps) else mask
        a, b = trie_forest(fps, group, budget)
        return pd.DataFrame({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    for level in range(LEVELS + 1):
        options = F.create_map(*(F.lit(x) for old, new in divide.items() for x in (_signed(old), [_signed(m) for m in new])))
        rows = rows.select("fp", F.explode(options[F.col("mask")]).alias("mask")).withColumn("stretch", F.col("fp").bitwiseAND(F.col("mask")))
        divide = {m: _masks(m, parts) for new in divide.values() for m in new}
        large = None
        if level < LEVELS:
            large = rows.groupBy("mask", "stretch").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_LIMIT).select("mask", "stretch")
            large = stage(large, "large-groups")
            # A large group has over GROUP_LIMIT members, which bounds their number by rows / GROUP_LIMIT.
            many = large.count()
            large = (F.broadcast(large) if many <= 100_000 else large) if many else None
        ready = rows.join(large, ["mask", "stretch"], "left_anti") if large is not None else rows
        tasks = max(64, -(-count * parts ** (level + 1) // TASK_ROWS))
        done = stage(ready.withColumn("task", F.pmod(F.xxhash64("mask", "stretch"), F.lit(tasks))).groupBy("task").applyInPandas(task, "a long, b long"), "links")
        found = done if found is None else found.unionByName(done)
        if large is None:
            break
        rows = rows.join(large, ["mask", "stretch"], "left_semi").select("fp", "mask")
    return found


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) for all nodes of undirected edges (a, b).

    Rounds of large and small stars: every node's edges move to the smallest neighbour, until nothing moves.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None, budget: int = MAX_BITS) -> DataFrame:
    """uid, doc_id, fp and component_id (smallest doc_id of all that links reach, null only if all are) of each row."""
    rows = fingerprints(docs, id_col, text_col, uid_col)
    first = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(links(first.select("fp"), budget))
    named = first.join(roots, first.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lows, "root").select("fp", "component_id"), "fp").select("uid", "doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each component the row with the smallest id, then the first."""
    own = free_name(docs, "_uid")
    rows = stage(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    found = stage(near_duplicates(rows, id_col, text_col, own), "near-duplicates")
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    # Components of null ids alone have the null id in common with others: their fingerprint tells them apart.
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    keep = found.groupBy(group.alias("g")).agg(stays.alias("s")).select(F.col("s.uid").alias(own))
    return rows.join(found.select(F.col("uid").alias(own)).join(keep, own, "left_anti"), own, "left_anti").select(docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
