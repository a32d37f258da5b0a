"""Materialised aggregates that are refreshed from changes: only buckets of keys that changed are written anew.

A view keeps, beside the base table, a row for each key with count, sum, least and most.  Both are dealt to buckets by key, each in a folder of
its own.  A refresh takes back what changed rows gave to their old keys and adds what they give to the new ones; a key that lost its
least or most value is aggregated again from its own rows.  Base and view change in one commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits
from .lineage import cut

BUCKETS = 32
#: Numbers are added as decimals, so that taking a value back leaves nothing of it.
_EXACT = "decimal(38,9)"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("key").isNull()), F.lit(buckets)).cast("int")


def _aggregated(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("value").cast(_EXACT)).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


def _write(rows: DataFrame, root: str, table: str, buckets: list[int], number: int, held: dict[str, list[str]]) -> None:
    """Writes the buckets of a table (column bucket) in one go, and puts their folders in the place of older ones."""
    path = commits.stage_partitioned(rows, root, "bucket")
    for k in buckets:
        held[f"{table}/{k}"] = [f"{path}/bucket={k}"] if commits.exists(rows.sparkSession, f"{root}/{path}/bucket={k}") else []


def create(spark: SparkSession, root: str, rows: DataFrame, buckets: int = BUCKETS) -> int:
    """The first version, of rows (id, key, value)."""
    base = cut(rows.select("id", "key", "value").withColumn("bucket", _bucket(buckets)))
    held: dict[str, list[str]] = {}
    _write(base, root, "base", list(range(buckets)), buckets, held)
    _write(_aggregated(base).withColumn("bucket", _bucket(buckets)), root, "view", list(range(buckets)), buckets, held)
    return commits.publish(spark, root, 0, held)


def _read(spark: SparkSession, root: str, tables: dict[str, list[str]], table: str, some: list[int], schema: str) -> DataFrame:
    paths = [f"{root}/{p}" for k in some for p in tables[f"{table}/{k}"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _schemas(key_type: str, value_type: str, id_type: str) -> tuple[str, str]:
    return f"id {id_type}, key {key_type}, value {value_type}", f"key {key_type}, n long, total {_EXACT}, least {value_type}, most {value_type}"


def view(spark: SparkSession, root: str, kinds: tuple[str, str, str], version: int | None = None) -> DataFrame:
    """key, n, total, least, most as of a version; kinds are the types of key, value and id."""
    _, tables = commits.manifest(spark, root, version)
    return _read(spark, root, tables, "view", range(len(tables) // 2), _schemas(*kinds)[1])


def refresh(spark: SparkSession, root: str, changes: DataFrame, kinds: tuple[str, str, str]) -> tuple[int, list[int]]:
    """Applies changes (id, key, value, deleted) and returns the new version and the buckets that were written.

    A change of an id that is there replaces its row, others insert one; deletions of ids that are not there do nothing.  Ids are distinct, in the table as in the changes.
    """
    version, tables = commits.manifest(spark, root)
    buckets, (base_kind, view_kind) = len(tables) // 2, _schemas(*kinds)
    every = list(range(buckets))
    changes = cut(changes.select("id", "key", "value", "deleted"))
    base = _read(spark, root, tables, "base", every, base_kind)
    old = cut(base.join(changes.select("id"), "id", "left_semi").select("key", "value", F.lit(-1).alias("sign")))
    moved = old.unionByName(changes.where("NOT deleted").select("key", "value", F.lit(1).alias("sign")))
    touched = sorted(r["bucket"] for r in moved.select(_bucket(buckets).alias("bucket")).distinct().collect())  # as many as buckets
    if not touched:
        return version, []
    stays = _read(spark, root, tables, "base", touched, base_kind).join(changes.select("id"), "id", "left_anti")
    added = changes.where("NOT deleted").select("id", "key", "value")
    held: dict[str, list[str]] = {}
    _write(stays.unionByName(added).withColumn("bucket", _bucket(buckets)), root, "base", touched, buckets, held)
    minus, plus = F.col("sign") < 0, F.col("sign") > 0
    delta = moved.groupBy("key").agg(
        F.sum("sign").alias("d_n"), F.sum(F.col("value").cast(_EXACT) * F.col("sign")).alias("d_total"), F.min(F.when(plus, F.col("value"))).alias("in_least"), F.max(F.when(plus, F.col("value"))).alias("in_most"),
        F.min(F.when(minus, F.col("value"))).alias("out_least"), F.max(F.when(minus, F.col("value"))).alias("out_most")).withColumnRenamed("key", "k")
    before = _read(spark, root, tables, "view", touched, view_kind)
    both = before.join(delta, before.key.eqNullSafe(delta.k), "full").withColumn("key", F.when(F.col("d_n").isNotNull(), F.col("k")).otherwise(F.col("key")))
    lost = (F.col("out_least") <= F.col("least")) | (F.col("out_most") >= F.col("most"))
    both = cut(both.select(
        "key", (F.coalesce("n", F.lit(0)) + F.coalesce("d_n", F.lit(0))).alias("n"), F.when(F.col("total").isNull() & F.col("d_total").isNull(), None).otherwise(F.coalesce("total", F.lit(0)) + F.coalesce("d_total", F.lit(0))).cast(_EXACT).alias("total"),
        F.least("least", "in_least").alias("least"), F.greatest("most", "in_most").alias("most"), F.coalesce(lost, F.lit(False)).alias("lost")).where("n > 0"))
    # Keys that lost an extreme are aggregated from their own rows, in the buckets just written.
    again = _read(spark, root, tables | held, "base", touched, base_kind)
    keys = both.where("lost").select(F.col("key").alias("k"))
    anew = _aggregated(again.join(keys, again.key.eqNullSafe(keys.k), "left_semi"))
    _write(both.where("NOT lost").drop("lost").unionByName(anew).withColumn("bucket", _bucket(buckets)), root, "view", touched, buckets, held)
    return commits.publish(spark, root, version, held), touched
