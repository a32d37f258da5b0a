"""Prefix trie of conversations: which first turns conversations share, and what computing them once would save.

A turn becomes a record of 20 bytes: a digest of role and text, and the text's length; a conversation is its records in
a row, so that common first turns are common first bytes.  Equal conversations are merged first, with the digest of
their ids.  Then comes a mergesort that carries longest common prefixes (LCPs, in turns): each range of conversations is
cut into sorted runs with the LCP of each row and the one before; runs beyond the first go to files in the shared folder;
a loser tree merges them and compares turns only where LCPs are equal.  A stack holds the open path: a row
closes the nodes below its LCP, which are then finished.  Nodes on the first and the last path of a range go on as
partial sums, path by path, and meet those of other ranges in rounds of at most 256 ranges a task.

Turns are ordered by turn (null first), then role, then the text's digest; null role and text are empty.  Rows without a
conv_id belong to no conversation.  Repeated rows are turns of their own.  An empty table has no nodes.  Other columns
are ignored.  A conversation is held as 20 bytes a turn by the task that sorts it, whatever the length of its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import remove, stage, table, work_path

RECORD = 20
#: Bytes of a sorted run, characters of a piece of joined ids, turns that ranges are cut by.
RUN_BYTES = 32 << 20
PIECE_CHARS = 1 << 16
RANGE_TURNS = 512
#: Finished children that wait for their parent's smallest member; more are sent ahead and joined with it later.
FAMILY = 4096
#: Ranges whose open paths meet in one task.
FAN_IN = 256
NO_ENDS = sha256(b"").hexdigest()

FINISHED, ANSWER, OPEN = 0, 1, 2
_NODE = "struct<conv_id: bigint, n: bigint, children: bigint, leaves: bigint, saved: bigint, ends: string, waiting: boolean>"
#: What the tasks return: finished nodes with their parent (or its key, to be joined), answers for those keys, open paths.
_SCHEMA = f"kind int, key binary, parent bigint, depth int, part bigint, side int, seq binary, nodes array<{_NODE}>"
_ARROW_NODE = pa.struct([(c, pa.int64()) for c in ("conv_id", "n", "children", "leaves", "saved")] + [("ends", pa.string()), ("waiting", pa.bool_())])
_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("parent", pa.int64()), ("depth", pa.int32()), ("part", pa.int64()), ("side", pa.int32()), ("seq", pa.binary()), ("nodes", pa.list_(_ARROW_NODE))])


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and seq, the records of its turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    record = F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0"))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", role.alias("role"), record.alias("record")).alias("item"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda x: x["record"]), "")
    return rows.groupBy("conv_id").agg(F.unhex(joined).alias("seq"))


def with_shared_heads(conversations: DataFrame, period: int = 100, kinds: int = 6) -> DataFrame:
    """Replaces the first h turns of conversation c by those of conversation c - c % period; h is crc32(c) % kinds."""
    heads = conversations.where(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("base"), F.substring("seq", 1, RECORD * kinds).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds * RECORD).cast("int")
    rows = conversations.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % period}).join(heads, "base", "left")
    nothing = F.lit(b"")
    head = F.coalesce(F.expr("substring(head, 1, h)"), nothing)
    return rows.select("conv_id", F.concat(head, F.expr("substring(seq, h + 1, length(seq))")).alias("seq"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the ids of each run of equal sequences, in pieces of a bounded size."""
    seq, ids, chars = None, [], 0
    out: list[tuple] = []

    def close() -> None:
        if ids:
            out.append((seq, ids[0], len(ids), ",".join(map(str, ids))))

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["seq", "first", "n", "ids"])

    for batch in batches:
        for s, i in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if s != seq or chars > PIECE_CHARS:
                close()
                seq, ids, chars = s, [], 0
            ids.append(i)
            chars += len(str(i)) + 1
        if out:
            yield flush()
            out.clear()
    close()
    if out:
        yield flush()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of all ids of each sequence, from its pieces in order."""
    names = ["seq", "conv_id", "n", "ends"]
    seq, first, n, digest = None, 0, 0, None
    for batch in batches:
        out = []
        for s, f, k, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "first", "n", "ids")), strict=True):
            if s != seq:
                if digest:
                    out.append((seq, first, n, digest.hexdigest()))
                seq, first, n, digest = s, f, 0, sha256()
            elif digest:
                digest.update(b",")
            n += k
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])
    if digest:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (seq, first, n, digest.hexdigest()), strict=True))])


def merged_equals(rebuilt: DataFrame) -> DataFrame:
    """A row for each distinct sequence: seq, its smallest conv_id, n, and the digest of its ids in ascending order.

    Ids are laid out by ranges of (hash of the sequence, id), so that many copies are spread over tasks, each of which joins its own.
    """
    laid = rebuilt.withColumn("hash", F.xxhash64("seq")).repartitionByRange("hash", "conv_id").sortWithinPartitions("hash", "seq", "conv_id")
    pieces = laid.select("seq", "conv_id").mapInArrow(_pieces, "seq binary, first bigint, n bigint, ids string")
    return pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_ends, "seq binary, conv_id bigint, n bigint, ends string")


def common_turns(a: bytes, b: bytes, turns: int = 0) -> int:
    """First turns that two sequences share, of which `turns` are known to be equal."""
    most = min(len(a), len(b)) // RECORD
    while turns < most and a[turns * RECORD : (turns + 1) * RECORD] == b[turns * RECORD : (turns + 1) * RECORD]:
        turns += 1
    return turns


def sorted_run(rows: list[tuple]) -> Iterator[tuple]:
    """(seq, LCP with the row before, rest...) of rows (seq, rest...) in order."""
    before = b""
    for seq, *rest in sorted(rows, key=lambda r: r[0]):
        yield (seq, common_turns(before, seq), *rest)
        before = seq


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Rows (seq, LCP, rest...) of sorted runs in one order, by a loser tree.

    The head of a run carries its LCP with the row that was last put out: of two heads, the one with the larger LCP is
    less; only where LCPs are equal, turns beyond them are compared, which gives the loser's LCP with the winner.
    """
    heads = [next(run, None) for run in runs]
    lcps = [0] * len(runs)  # nothing is out yet
    losers = [-1] * len(runs)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        shared = common_turns(x, y, lcps[a])
        winner, loser = (a, b) if x[shared * RECORD :] <= y[shared * RECORD :] else (b, a)
        lcps[loser] = shared
        return winner, loser

    def build(node: int) -> int:
        if node >= len(runs):
            return node - len(runs)
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if runs else -1
    while runs and heads[winner] is not None:
        seq, _, *rest = heads[winner]
        yield (seq, lcps[winner], *rest)
        heads[winner] = next(runs[winner], None)
        lcps[winner] = heads[winner][1] if heads[winner] else 0
        node = (winner + len(runs)) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


class _Node:
    """An open node: sums over what is closed below it and what ends at it."""

    __slots__ = ("chars", "children", "conv", "ends", "family", "leaves", "n", "saved", "waiting")

    def __init__(self, chars: int) -> None:
        self.chars, self.conv, self.n, self.children, self.leaves, self.saved = chars, None, 0, 0, 0, 0
        self.ends, self.waiting, self.family = None, False, []

    def add(self, conv: int | None, n: int, children: int, leaves: int, saved: int, ends: str | None, waiting: bool) -> None:
        if conv is not None:
            self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        self.ends, self.waiting = self.ends or ends, self.waiting or waiting

    def values(self) -> tuple:
        return self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.waiting


class OpenPath:
    """The stack of open nodes.  Sequences come in order; rows of finished nodes gather in `out`.

    Unless it is the last round, nodes on the first and the last path stay open: their sums become paths for the next round.
    """

    def __init__(self, part: int, last_round: bool, family: int = FAMILY) -> None:
        self.part, self.last_round, self.family, self.out = part, last_round, family, []
        self.stack: list[_Node] = []
        self.seq = self.first = b""
        self.edge = -1  # the deepest open node on the first path
        self.left: dict[int, tuple] = {}

    def add(self, seq: bytes, lcp: int, values: dict[int, tuple]) -> None:
        """A sequence that shares lcp turns with the one before; what it adds to its nodes by depth."""
        depth = len(seq) // RECORD
        if not self.stack:
            self.stack.append(_Node(0))
            if not self.last_round:
                self.first, self.edge = seq, depth
        else:
            self._close(lcp)
        for k in range(len(self.stack) - 1, depth):
            self.stack.append(_Node(int.from_bytes(seq[k * RECORD + 16 : (k + 1) * RECORD])))
        self.seq = seq
        for d, v in values.items():
            self.stack[d].add(*v)

    def end(self) -> None:
        if not self.stack:
            return
        if self.last_round:
            self._close(0)
            root = self.stack.pop()
            self._finish(root, 0)
            self.out.append((FINISHED, None, None, 0, None, None, None, [root.values()]))
            return
        for d, node in enumerate(self.stack):
            self._send_ahead(node, d, self.seq)
        if self.left:
            zeros = (None, 0, 0, 0, 0, None, False)
            self.out.append((OPEN, None, None, None, self.part, 0, self.first, [self.left.get(d, zeros) for d in range(len(self.first) // RECORD + 1)]))
        self.out.append((OPEN, None, None, None, self.part, 1, self.seq, [node.values() for node in self.stack]))

    def _close(self, depth: int) -> None:
        while len(self.stack) - 1 > depth:
            d, node = len(self.stack) - 1, self.stack.pop()
            if d <= self.edge:
                self._send_ahead(node, d, self.first)
                self.left[d], self.edge = node.values(), d - 1
                continue
            self._finish(node, d)
            parent = self.stack[-1]
            parent.add(node.conv, node.n, 1, node.leaves, node.saved, None, False)
            parent.family.append(node.values())
            if len(parent.family) >= self.family:
                self._send_ahead(parent, d - 1, self.seq)

    def _finish(self, node: _Node, depth: int) -> None:
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.chars
        if node.family:
            self.out.append((FINISHED, None, node.conv, depth + 1, None, None, None, node.family))
        if node.waiting:
            self.out.append((ANSWER, self._key(self.seq, depth), node.conv, None, None, None, None, None))

    def _send_ahead(self, node: _Node, depth: int, seq: bytes) -> None:
        """Finished children of a node whose smallest member is not known yet."""
        if node.family:
            self.out.append((FINISHED, self._key(seq, depth), None, depth + 1, None, None, None, node.family))
            node.family, node.waiting = [], True

    @staticmethod
    def _key(seq: bytes, depth: int) -> bytes:
        return sha256(seq[: depth * RECORD]).digest()


def _batch(out: list[tuple]) -> pa.RecordBatch:
    names = [f.name for f in _ARROW_NODE]
    columns = [list(c) for c in zip(*out, strict=True)]
    columns[-1] = [None if nodes is None else [dict(zip(names, v, strict=True)) for v in nodes] for nodes in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


_RUN = pa.schema([("seq", pa.large_binary()), ("lcp", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def _written(rows: list[tuple], folder: str) -> str:
    """A sorted run as a file."""
    uri, stream = files.create(folder, ".run")
    with stream, pa.ipc.new_stream(stream, _RUN) as out:
        run, rows = sorted_run(rows), []
        while some := [r for _, r in zip(range(2000), run)]:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _RUN, strict=True)], schema=_RUN))
    return uri


def _read(uri: str) -> Iterator[tuple]:
    with files.open_file(uri) as source, pa.ipc.open_stream(source) as batches:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _trie_of_range(folder: str, run_bytes: int, family: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, rows, size = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "conv_id", "n", "ends")), strict=True):
                if size > run_bytes:
                    runs.append(_written(rows, folder))
                    rows, size = [], 0
                rows.append(row)
                size += len(row[0]) + 200
        path = OpenPath(TaskContext.get().partitionId(), False, family)
        for seq, lcp, conv, n, ends in merged([sorted_run(rows), *map(_read, runs)]):
            path.add(seq, lcp, {len(seq) // RECORD: (conv, n, 0, 0, 0, ends, False)})
            if len(path.out) >= 1000:
                yield _batch(path.out)
                path.out = []
        path.end()
        if path.out:
            yield _batch(path.out)

    return task


def _meet(last_round: bool, fan_in: int, family: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Goes through the open paths of neighbouring ranges as through sequences."""

    def task(paths: pd.DataFrame) -> pd.DataFrame:
        paths = paths.sort_values(["part", "side"])
        path, before = OpenPath(int(paths["part"].iloc[0]) // fan_in, last_round, family), b""
        for seq, nodes in zip(paths["seq"], paths["nodes"], strict=True):
            seq = bytes(seq)
            whole = lambda x: None if x is None or x != x else int(x)  # noqa: E731  pandas has no integer nulls
            values = {d: (whole(v["conv_id"]), *(int(v[c]) for c in ("n", "children", "leaves", "saved")), v["ends"], v["waiting"]) for d, v in enumerate(nodes)}
            path.add(seq, common_turns(before, seq), values)
            before = seq
        path.end()
        return _batch(path.out).to_pandas(types_mapper=lambda t: pd.Int64Dtype() if t == pa.int64() else pd.Int32Dtype() if t == pa.int32() else None) if path.out else pd.DataFrame(columns=_ARROW.names)

    return task


def trie(conversations: DataFrame, run_bytes: int = RUN_BYTES, family: int = FAMILY, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each distinct sequence of first turns, the empty one included.

    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (over its subtree, members but one times the length of the last text), ends_sha256 (of the ids that end there).
    """
    spark = conversations.sparkSession
    distinct = stage(merged_equals(conversations), "trie-sequences")
    folder = work_path(spark, "trie-runs")
    laid = distinct.repartitionByRange(F.substring("seq", 1, RANGE_TURNS * RECORD)).select("seq", "conv_id", "n", "ends")
    done = stage(laid.mapInArrow(_trie_of_range(folder, run_bytes, family), _SCHEMA), "trie-ranges")
    remove(spark, folder)
    found, paths = [done], done.where(f"kind = {OPEN}")
    most = paths.agg(F.max("part")).first()[0] or 0
    while True:
        last = most < fan_in
        done = stage(paths.groupBy(F.floor(F.col("part") / fan_in)).applyInPandas(_meet(last, fan_in, family), _SCHEMA), "trie-paths")
        found.append(done)
        if last:
            break
        paths, most = done.where(f"kind = {OPEN}"), most // fan_in
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    known = rows.where(f"kind = {FINISHED} AND key IS NULL").select("parent", "depth", "nodes")
    answers = rows.where(f"kind = {ANSWER}").select("key", "parent")
    ahead = rows.where(f"kind = {FINISHED} AND key IS NOT NULL").select("key", "depth", "nodes")
    families = known.unionByName(ahead.join(answers, "key").select("parent", "depth", "nodes"))
    node = F.col("node")
    return families.select("parent", "depth", F.explode("nodes").alias("node")).select(
        node["conv_id"].alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
        node["n"].alias("n_convs"), node["children"].alias("n_children"), node["leaves"].alias("n_leaves"), node["saved"].alias("saved_tokens"), F.coalesce(node["ends"], F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(with_shared_heads(sequences(table(spark, sf_dir, "conversations"))))
