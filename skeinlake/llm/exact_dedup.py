"""Exact deduplication as a stream with keyed state.

A reading normalises the texts, writes each one compressed to a content file in the shared folder, and hands on its
digest and its locator (file, place and size there).  The state, on disk in RocksDB and never expired, keeps for each digest
the number of rows, the identifier of the row that stays, and its locator.  Where a digest was hit, both
texts are fetched by their locators and compared, byte for byte.

A folder that is named keeps state, digests and contents for later loads, whose rows are held against all earlier ones.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import SPACES, exists, free_name, remove, shared_dir, slices, small_batches, stage, strings, table, work_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Else each partition's store takes some megabytes of disk in advance, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Staged files that one micro-batch reads.
FILES_PER_BATCH = 2000
#: Characters of the digest that are the key: all of them.
DIGEST_CHARS = 64
#: Keys above this share of the rows, at most its inverse in number, are joined by broadcast.
HOT_SHARE = 0.001
#: Bytes of contents that a task keeps while it compares.
KEPT_BYTES = 32 << 20
ROWS = "sha string, doc_id long, uid long, points long, file string, at long, size long"
BEST = "struct<points:bigint,no_id:boolean,doc_id:bigint,file:string,at:bigint,size:bigint>"


def store_texts(docs: DataFrame, folder: str, id_col: str, text_col: str, uid_col: str | None) -> DataFrame:
    """Writes normalised texts to content files; a row each with its digest and locator."""
    small_batches(docs.sparkSession)
    spaces = SPACES.encode()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = "", None, 0
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            if out is None:
                path, out = files.create(folder, ".zst")
                name = path.rsplit("/", 1)[1]
            texts = strings(batch.column(1))
            sha, sizes = [], []
            for text in texts.cast(pa.large_binary()).to_pylist():
                bare = text.translate(None, spaces)
                sha.append(hashlib.sha256(bare).hexdigest())
                packed = pack(bare)
                sizes.append(len(packed))
                out.write(packed)
            ends = at + np.cumsum(sizes, dtype=np.int64)
            columns = [pa.array(sha, pa.string()), batch.column(0), batch.column(2), pc.utf8_length(texts).cast(pa.int64()), pa.array([name] * len(sha), pa.string()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["sha", "doc_id", "uid", "points", "file", "at", "size"])
            at = int(ends[-1]) if len(ends) else at
        if out is not None:
            out.close()

    uid = F.col(uid_col).cast("long") if uid_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), uid.alias("uid"))
    return rows.mapInArrow(task, ROWS)


def _reader(folder: str):
    """Fetches a text by its locator; files stay open and some texts are kept for the task's next rows."""
    opened = functools.lru_cache(maxsize=64)(lambda name: files.open_file(f"{folder}/{name}"))
    unpack, kept, held = zstandard.ZstdDecompressor(), {}, 0

    def fetch(name: str, at: int, size: int, keep: bool = False) -> bytes:
        nonlocal held
        if keep and (text := kept.get((name, at))) is not None:
            return text
        text = unpack.decompress(opened(name).read_at(size, at))
        if keep:
            if held + len(text) > KEPT_BYTES:
                kept.clear()
                held = 0
            kept[name, at] = text
            held += len(text)
        return text

    return fetch


def _best() -> Column:
    """The row that stays: most code points, then smallest id (null last), then any, always the same."""
    return F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "at", "size")).alias("best")


def fold_stream(spark: SparkSession, folder: str, load: str, chars: int) -> DataFrame:
    """Runs the digests of a load through the stream; a row for each key of it with n and best over all loads."""
    out = f"{folder}/state/load={load}"
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", FILES_PER_BATCH).option("recursiveFileLookup", "true").parquet(f"{folder}/digests")
        query = (
            stream.groupBy(F.substring("sha", 1, chars).alias("key"))
            .agg(F.count("*").alias("n"), _best())
            .writeStream.outputMode("update")
            # A repeated batch overwrites what it has left before.
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = f"key string, n bigint, best {BEST}"
    if not exists(spark, out):  # an empty load
        return spark.createDataFrame([], schema)
    # A key's last update has the largest count.
    return spark.read.schema(schema).parquet(out).groupBy("key").agg(F.max(F.struct("n", "best")).alias("s")).select("key", "s.n", "s.best")


def compare(hits: DataFrame, folder: str) -> DataFrame:
    """The keys of hits whose bytes are not those of the row that stays."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = _reader(folder)
        for batch in batches:
            keys = {k for k, f, a, s, bf, ba, bs in zip(*(c.to_pylist() for c in batch.columns), strict=True) if fetch(f, a, s) != fetch(bf, ba, bs, keep=True)}
            yield pa.RecordBatch.from_pydict({"key": pa.array(sorted(keys), pa.string())})

    rows = hits.select("key", "file", "at", "size", F.col("best.file").alias("bf"), F.col("best.at").alias("ba"), F.col("best.size").alias("bs"))
    return rows.repartition("file").sortWithinPartitions("file", "at").mapInArrow(task, "key string").distinct()


def tell_apart(rows: DataFrame, folder: str) -> DataFrame:
    """n and best for each text of rows that share a key: by the bytes themselves."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = _reader(folder)
        for batch in batches:
            got = [fetch(f, a, s) for f, a, s in zip(*(batch.column(k).to_pylist() for k in ("file", "at", "size")), strict=True)]
            yield batch.append_column("content", pa.array(got, pa.binary()))

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return stage(rows.repartition("file").mapInArrow(task, kinds + ", content binary"), "told-apart")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uid_col: str | None = None, folder: str | None = None, load: str | None = None, chars: int = DIGEST_CHARS) -> DataFrame:
    """One row for each row: uid, doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty and equal to texts of white space alone.  Rows may repeat, ids may repeat or be null:
    exactly one row of each group stays.  Other columns are ignored; `uid_col` names a number that is handed on as `uid`.
    An empty table gives no row.

    `folder` keeps what it takes to deduplicate later loads against this one: their group sizes and kept rows are
    those over all loads so far.  A row that stayed in an earlier load is displaced by an equal one with more code points or a smaller id;
    results that were given before are not revised.  A load that failed is repeated under the same `load` name
    without counting its rows twice.
    """
    spark, lasting = docs.sparkSession, folder is not None
    folder, load = (folder or work_path(spark, "exact-dedup")).rstrip("/"), load or uuid.uuid4().hex
    contents, digests, known = f"{folder}/contents", f"{folder}/digests/load={load}", f"{folder}/collisions"
    if not exists(spark, f"{digests}/_SUCCESS"):
        store_texts(docs, contents, id_col, text_col, uid_col).write.mode("overwrite").parquet(digests)
    state = fold_stream(spark, folder, load, chars)
    key = F.substring("sha", 1, chars).alias("key")
    state, rows = stage(state, "state"), spark.read.schema(ROWS).parquet(digests).select("*", key)
    # Keys with more than a HOT_SHARE of the rows are as few as that allows: they are sent to all tasks, so that no task gets all rows of one.
    total = state.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(state.where(F.col("n") > HOT_SHARE * total))
    cold = rows.join(hot.select("key"), "key", "left_anti").join(state.where(F.col("n") <= HOT_SHARE * total), "key")
    rows = stage(rows.join(hot, "key").unionByName(cold), "decided")
    apart = compare(rows.where("n > 1 AND NOT (file = best.file AND at = best.at)"), contents)
    if exists(spark, known):
        apart = apart.unionByName(spark.read.schema("key string").parquet(known)).distinct()
    apart = stage(apart, "collisions")
    own = (F.col("file") == F.col("best.file")) & (F.col("at") == F.col("best.at"))
    columns = ["uid", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), own.alias("kept"), F.col("sha").alias("text_sha256")]
    if not apart.limit(1).count():
        if not lasting:  # what is left to read was written elsewhere
            remove(spark, folder)
        return rows.select(columns)
    apart.write.mode("append").parquet(known)
    # Texts that share a key, of all loads so far: they are grouped by their bytes.
    every = spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{folder}/digests")
    every = tell_apart(every.select("*", key).join(apart, "key", "left_semi"), contents)
    groups = every.groupBy("key", "content").agg(F.count("*").alias("n"), _best())
    mine = rows.join(apart, "key", "left_semi").select("file", "at")
    mine = every.join(mine, ["file", "at"]).join(groups, ["key", "content"])
    return rows.join(apart, "key", "left_anti").select(columns).unionByName(mine.select(columns))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, load: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    uid = free_name(docs, "_uid")
    rows = stage(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    gone = decide(rows, id_col, text_col, uid, folder, load).where(~F.col("kept")).select(F.col("uid").alias(uid))
    return rows.join(gone, uid, "left_anti").select(docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return decide(table(spark, sf_dir, "documents")).drop("uid")
