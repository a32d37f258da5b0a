"""Token-id files of patched frame-of-reference blocks.

A shard holds consecutive documents.  Its ids are cut into blocks; a block stores its minimum,
the differences from it packed at the width that a given share of them fits, and the rest as
exceptions (position and difference).  The footer indexes where blocks start, so that a reader
can fetch any document without decoding the blocks before it.

Layout (little-endian): magic, blocks, index of block starts (u64 each), document ids (i64),
null flags (u8), document lengths (u64), then the trailer: documents, ids, blocks, block size
(u64 each) and the magic again.  Block: minimum u32, width u8, ids u32, exceptions u32, packed
bits, exception positions u32, exception differences u32.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files, tokens
from .common import ids_frame, offsets_of, slices, small_batches, stage, table, work_path

MAGIC = b"PFORIDS1"
BLOCK_IDS = 1024
#: Share of a block's differences that must fit the packed width.
PACKED_SHARE = 0.95
#: Ids of a shard; a longer document still stays in one shard.
SHARD_IDS = 8_000_000
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("n", "<u4"), ("out", "<u4")])
MANIFEST = "part int, shard int, path string, n_docs long, n_ids long"


def _widths(limits: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(limits.astype(np.float64) + 1)).astype(np.int64)


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values packed at `width` bits each."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(*values.shape, 4), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def encode_blocks(ids: np.ndarray, block: int = BLOCK_IDS, share: float = PACKED_SHARE) -> list[bytes]:
    """The blocks of an array of unsigned 32-bit ids."""
    whole = len(ids) // block
    out = _encode_rows(ids[: whole * block].reshape(whole, block), share)
    return out + (_encode_rows(ids[None, whole * block :], share) if whole * block < len(ids) else [])


def _encode_rows(rows: np.ndarray, share: float) -> list[bytes]:
    if not rows.size:
        return []
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    at = int(np.ceil(share * rows.shape[1])) - 1
    widths = _widths(np.partition(rest, at, axis=1)[:, at])
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        for some in np.array_split(chosen, len(chosen) // 256 + 1):
            over = rest[some] >> np.uint32(width) != 0 if width < 32 else np.zeros(rest[some].shape, bool)
            packed = _bits(rest[some], int(width))
            for k, i in enumerate(some):
                where = np.flatnonzero(over[k])
                head = np.array([(low[i], width, rows.shape[1], len(where))], _HEAD)
                out[i] = b"".join((head.tobytes(), packed[k].tobytes(), where.astype("<u4").tobytes(), rest[i, where].astype("<u4").tobytes()))
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at `starts`; all but the last have the same number of ids."""
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD)[:, 0]
    begin = offsets_of(heads["n"].astype(np.int64))
    ids = np.zeros(begin[-1], np.uint32)
    for width, n in {(int(h["width"]), int(h["n"])) for h in heads}:
        chosen, size = np.flatnonzero((heads["width"] == width) & (heads["n"] == n)), (width * n + 7) // 8
        for some in np.array_split(chosen, len(chosen) // 256 + 1):
            packed = raw[(starts[some] + _HEAD.itemsize)[:, None] + np.arange(size)]
            bits = np.zeros((len(some), n, 32), np.uint8)
            bits[:, :, :width] = np.unpackbits(packed, axis=1, count=width * n, bitorder="little").reshape(len(some), n, width)
            rows = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
            for k, i in enumerate(some):
                if out := int(heads["out"][i]):
                    after = int(starts[i]) + _HEAD.itemsize + size
                    rows[k, np.frombuffer(data, "<u4", out, after)] = np.frombuffer(data, "<u4", out, after + 4 * out)
                ids[begin[i] : begin[i + 1]] = rows[k] + heads["low"][i]
    return ids


def write_shard(folder: str, doc_ids: list, lengths: list[int], ids: np.ndarray) -> str:
    """Writes one shard and returns its path."""
    blocks = encode_blocks(ids)
    starts = len(MAGIC) + offsets_of(np.array([len(b) for b in blocks], np.int64))
    path, out = files.create(folder, ".pfor")
    with out:
        out.write(MAGIC)
        for b in blocks:
            out.write(b)
        out.write(starts.astype("<u8").tobytes())
        out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
        out.write(np.array([x is None for x in doc_ids], "u1").tobytes())
        out.write(np.array(lengths, "<u8").tobytes())
        out.write(np.array([len(doc_ids), len(ids), len(blocks), BLOCK_IDS], "<u8").tobytes())
        out.write(MAGIC)
    return path


class Shard:
    """A shard for reading: its documents' ids and lengths, and any run of its token ids."""

    def __init__(self, path: str):
        self.file = files.open_file(path)
        size, tail = self.file.size(), 32 + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[32:] != MAGIC:
            raise ValueError(f"{path} is not a token-id file")
        docs, self.n_ids, blocks, self.block = (int(x) for x in np.frombuffer(end[:32], "<u8"))
        at = size - tail - 17 * docs - 8 * (blocks + 1)
        index = self.file.read_at(size - tail - at, at)
        self.starts = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        numbers = np.frombuffer(index, "<i8", docs, 8 * (blocks + 1))
        nulls = np.frombuffer(index, "u1", docs, 8 * (blocks + 1 + docs))
        self.doc_ids = [None if null else int(x) for x, null in zip(numbers, nulls, strict=True)]
        self.offsets = offsets_of(np.frombuffer(index, "<u8", docs, 8 * (blocks + 1) + 9 * docs).astype(np.int64))

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Token ids from `begin` to `end`: only the blocks that hold them are read."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        data = self.file.read_at(int(self.starts[last + 1] - self.starts[first]), int(self.starts[first]))
        got = decode_blocks(data, self.starts[first : last + 1] - self.starts[first])
        return got[begin - first * self.block : end - first * self.block]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes them as shards in ascending `id_col` order; returns the manifest.

    Null texts are empty (only `end_id`), null ids come first, and equal ids keep one row each in
    any order among themselves.  Other columns are ignored; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_path(spark, "token-ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        held, names, lengths = [], [], []

        def flush():
            nonlocal shard
            ids = np.concatenate(held)
            path = write_shard(folder, names, lengths, ids)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(names)], "n_ids": [len(ids)]})
            shard += 1
            held.clear(), names.clear(), lengths.clear()
            return row

        for batch in slices(batches):
            ids, offsets = tokens.append_id(*tokens.encode(batch.column(1), tokenizer), end_id)
            held.append(ids)
            names += batch.column(0).to_pylist()
            lengths += np.diff(offsets).tolist()
            if sum(map(len, held)) >= SHARD_IDS:
                yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stage(ordered.mapInArrow(task, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads shards back: a row per document with its place among all ids, length, checksum and, if asked for, ids."""
    spark = manifest.sparkSession
    # One row for each task that wrote: what the driver keeps of those tasks anyway.
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("shards")).orderBy("part").collect()
    begins = offsets_of(np.array([r["n"] for r in totals], np.int64)).tolist()
    bases = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, begins, strict=False)], "part int, base long")
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.join(F.broadcast(bases), "part").select("path", (F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("base"))
    spread = placed.repartition(max(1, min(sum(r["shards"] for r in totals), 20_000)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                # Whole runs of documents at once, about a million ids each.
                for run in np.array_split(np.arange(len(shard.doc_ids)), max(1, min(len(shard.doc_ids), shard.n_ids // 1_000_000))):
                    first, end = int(run[0]), int(run[-1]) + 1
                    got, offsets = shard.ids(int(shard.offsets[first]), int(shard.offsets[end])), shard.offsets[first : end + 1] - shard.offsets[first]
                    frames = [ids_frame(got[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    out = {
                        "doc_id": pa.array(shard.doc_ids[first:end], pa.int64()),
                        "start": pa.array(base + shard.offsets[first:end]),
                        "n_tokens": pa.array(np.diff(offsets)),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in frames], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in frames], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return spread.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(manifest)
