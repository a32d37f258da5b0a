"""Packing of documents into sequences of at most a given number of tokens, by sums of squares.

Of a group's pieces, longest first, each goes where the sum, over residual gaps, of the squared number of
open sequences with that gap becomes smallest.  Groups of documents are packed apart;
sequences that stay too empty are opened again, and their documents packed with those of other groups, in as many groups
as there are documents for.  This ends with one group, or where lengths do not fill sequences any better.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import ids_frame, slices, small_batches, stage, table

SEQUENCE_TOKENS = 1024
#: Pieces that one task packs at a time.
GROUP_PIECES = 6_000
#: Sequences with a gap of more than one such part are opened again.
SLACK = 16
#: Where a round closes the sequences of less than this share of its pieces, more rounds do not pay.
LEAST_CLOSED = 0.1
#: Rounds at most: sequence numbers have room for so many.
MOST_ROUNDS = 15
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_into_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of at most `size`: only longer documents are cut, and the first piece takes the odd rest.

    A null text is empty and gives one piece with `end_id` alone.  Null and repeated ids are kept as they
    are; other columns are ignored, and an empty table gives no piece.
    """
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, offsets = tokens.append_id(*tokens.encode(batch.column(1), tokenizer), end_id)
            lengths = np.diff(offsets)
            count = -(-lengths // size)
            doc = np.repeat(np.arange(len(lengths)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = lengths - (count - 1) * size
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
            length = np.where(piece == 0, first[doc], size)
            begin = offsets[doc] + start
            frames = [ids_frame(ids[a : a + n]) for a, n in zip(begin, length, strict=True)]
            out = {
                "doc_id": batch.column(0).take(pa.array(doc)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in frames], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in frames], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, PIECES + ", ids array<long>" * with_ids)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A sequence number and an offset for each length below `size`, placed one after the other, longest first.

    A new sequence is opened only where no open one has room, which on whole batches beats opening
    one whenever that gives the smallest sum.
    """
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        # What the sum gains where gap g in n .. size - 1 becomes g - n; a filled sequence leaves the sum.
        gain = 2 * (count[: size - n] - count[n:size] + 1)
        gain[0] = 1 - 2 * count[n]
        gain[count[n:size] == 0] = np.inf
        gap = n + int(gain.argmin())
        if np.isfinite(gain[gap - n]):
            k = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, k, used = size, used, used + 1
        sequence[i], offset[i] = k, size - gap
        if left := gap - n:
            open_at[left].append(k)
            count[left] += 1
    return sequence, offset


def _packer(size: int, level: int, last: bool):
    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        lengths = rows["length"].to_numpy()
        sequence, offset = sum_of_squares(lengths, size)
        used = np.bincount(sequence, lengths, minlength=1)
        again = (used[sequence] < size - size // SLACK) & (not last)
        return pd.DataFrame({"_row": rows["_row"], "length": lengths, "_round": level, "_group": key[0], "_sequence": sequence, "offset": offset, "_open": again})

    return task


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS, group: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` from 1 to `size`.

    Full pieces are sequences of their own.  All columns are kept but earlier ones of these two names, nulls in them
    do not matter, and equal rows are packed apart.  Each round packs groups of about `group` pieces in parallel; the pieces
    of sequences with too large a gap go on to the next round.  The last round, whose sequences stay as they are,
    has one group, or closes less than LEAST_CLOSED of its pieces, or is number MOST_ROUNDS.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    row = F.monotonically_increasing_id().alias("_row")
    pieces = stage(pieces.select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate(names)), F.col("length").cast("long").alias("length"), row), "pieces")
    full = pieces.where(F.col("length") == size).select("_row", F.lit(0).alias("_round"), F.lit(0).alias("_group"), F.col("_row").alias("_sequence"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < size).select("_row", "length")
    n, level, done = rest.count(), 1, [full]
    schema = "_row long, length long, _round int, _group int, _sequence long, offset long, _open boolean"
    while True:
        groups = max(1, -(-n // group))
        last = groups == 1 or level == MOST_ROUNDS
        spread = rest.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)).cast("int"))
        packed = stage(spread.groupBy("_group").applyInPandas(_packer(size, level, last), schema), "packed")
        rest = packed.where("_open").select("_row", "length")
        still = rest.count()
        last = last or n - still < LEAST_CLOSED * n
        done.append((packed if last else packed.where(~F.col("_open"))).select("_row", "_round", "_group", "_sequence", "offset"))
        if last or not still:
            break
        n, level = still, level + 1
    placed = done[0]
    for other in done[1:]:
        placed = placed.unionByName(other)
    # One integer: full pieces have their row number, others a negative number of round, group and place in the group,
    # which has room for 15 rounds, 2^32 groups and 2^26 sequences in a group.
    number = F.when(F.col("_round") == 0, F.col("_sequence")).otherwise(-((F.col("_round").cast("long") * (1 << 32) + F.col("_group")) * (1 << 26) + F.col("_sequence")) - 1)
    return pieces.join(placed.select("_row", "offset", number.alias("sequence_id")), "_row").select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(names)), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces with `ids`: what a training job reads."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut_into_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
