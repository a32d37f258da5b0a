"""Structured Streaming over learner events: counters, running means, rate limits and first events.

Aggregations run in update mode; each micro-batch writes the rows that it changed in a folder of its own, again if
it is repeated, and the newest row of each key is the result.  No table passes through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder


def source(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of a Parquet file, or of all files of a folder, with the schema that they have; times without a zone are UTC's."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        rows, path = rows.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return rows.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run(rows: DataFrame, mode: str = "update") -> DataFrame:
    """Reads all that is there now, and returns what the batches wrote, with the number of the batch as `batch`."""
    spark, folder = rows.sparkSession, _folder(rows.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream = rows.writeStream.outputMode(mode).option("checkpointLocation", folder + "/state").trigger(availableNow=True).foreachBatch(write).start()
    stream.awaitTermination()
    return spark.read.schema(rows.schema.add("batch", "long")).parquet(folder + "/out")


def newest(written: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def counters(events: DataFrame, keys: list[str], duration: str, measures: dict[str, Column]) -> DataFrame:
    """Tumbling windows by key; `start` is the window's begin.

    Runs end with what is there, so there is no watermark: rows count however late they come, and the state holds all windows.
    """
    windows = events.groupBy(*keys, F.window("ts", duration).alias("w")).agg(*(c.alias(n) for n, c in measures.items()))
    return newest(run(windows.select(*keys, F.col("w.start").alias("start"), *measures)), [*keys, "start"])


def totals(events: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Aggregates of each key over the whole stream."""
    return newest(run(events.groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))), keys)
