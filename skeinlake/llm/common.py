"""Helpers that the training-data operators share.

Every operator reads whole texts.  A null text counts as an empty one, and a word is a
maximal run of characters outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python task works on at once; longer single texts form a slice of their own.
SLICE_BYTES = 8 << 20


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors and the driver share.

    Where that setting is missing, Spark on one machine (tests, a notebook) takes a temporary folder for each application;
    on a cluster it is an error, as executors would write to folders of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="skeinlake-")
        path = _OWN_DIRS[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or one like it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stage(df: DataFrame) -> None:
    """Deletes the folder of a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows of about `limit` bytes; a longer row stays whole."""
    for batch in batches:
        begin, n = 0, batch.num_rows
        step = max(1, int(n * limit / max(batch.nbytes, 1)))
        while begin < n:
            yield batch.slice(begin, step)
            begin += step
            pa.default_memory_pool().release_unused()


def strings(column: pa.Array) -> pa.Array:
    """Texts of a column, nulls as empty ones, with offsets that cannot overflow.

    They are a copy that begins at its buffers' start: some of Arrow's kernels (ascii_lower) misread slices.
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([pa.array([], pa.large_string()), texts])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and the offsets at which each text's words begin."""
    trimmed = pc.ascii_trim_whitespace(texts)
    parts = pc.ascii_split_whitespace(trimmed)
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pc.not_equal(flat, ""))
        counts = np.where(empty, 0, counts)
    return flat, offsets_of(counts)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run of values; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def codes_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words, and the distinct words."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes_of(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of strings that are alike in every process."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)


def ranks_of_windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Numbers that are equal exactly where the `width` codes from there on are equal; width is a power of two."""
    ranks = codes
    step = 1
    while step < width:
        if len(ranks) <= step:
            return np.zeros(0, np.int64)
        bound = int(ranks.max()) + 1
        ranks = pd.factorize(ranks[:-step] * bound + ranks[step:])[0]
        step *= 2
    return ranks


def ids_frame(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()


def map_arrow(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(task, schema)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of few rows: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
