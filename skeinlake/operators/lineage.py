"""Cutting the lineage of iterations, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the checkpoint folder of the context; a temporary one only on one machine, where both may be missing."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="skeinlake-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: written once, unlike a checkpoint, which computes its rows twice."""
    path = fresh_path(rows.sparkSession, "cut")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
