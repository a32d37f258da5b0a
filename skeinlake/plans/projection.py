"""Domain tables as projections of the driver tables: learner events, progress, concepts and prerequisites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Status of a learner's concept by the type of the event that set it.
STATUS = {"purchase": "mastered", "signup": "completed", "click": "in_progress", "view": "not_started", "error": "not_started"}

#: The same projection in SQL, as common table expressions that queries begin with.
LEARNER_EVENTS_SQL = """
learner_events AS (
  SELECT event_id, ts, user_id AS student_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS concept_id,
         CASE event_type WHEN 'purchase' THEN 'mastered' WHEN 'signup' THEN 'completed' WHEN 'click' THEN 'in_progress' ELSE 'not_started' END AS status,
         event_type, value AS seconds, least(1.0, value / 100) AS score
  FROM events
)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learner_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, student_id, concept_id, status, event_type, seconds, score."""
    status = F.lit("not_started")
    for kind, name in STATUS.items():
        if name != "not_started":
            status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return read(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("student_id"),
        F.get_json_object("props", "$.k").cast("int").alias("concept_id"),
        status.alias("status"),
        "event_type",
        F.col("value").alias("seconds"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("score"),
    )


#: Concepts are parts; concept k requires k div 2, and k div 3 as well if the size of its part is divisible by 3.
CONCEPTS_SQL = "concepts AS (SELECT p_partkey AS node FROM part)"
PREREQUISITES_SQL = """prerequisites AS (
  SELECT p_partkey AS src, p_partkey // 2 AS dst, 'STRONG' AS strength FROM part WHERE p_partkey >= 2
  UNION ALL SELECT p_partkey, p_partkey // 3, 'WEAK' FROM part WHERE p_partkey >= 4 AND p_size % 3 = 0
)"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src requires dst, strength)."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), "p_size")
    kinds = F.array(F.struct(F.lit(2).alias("by"), F.lit("STRONG").alias("strength")), F.struct(F.lit(3).alias("by"), F.lit("WEAK").alias("strength")))
    edges = rows.withColumn("kind", F.explode(kinds)).where("kind.by = 2 AND src >= 2 OR kind.by = 3 AND src >= 4 AND p_size % 3 = 0")
    return edges.select("src", F.floor(F.col("src") / F.col("kind.by")).alias("dst"), "kind.strength")
