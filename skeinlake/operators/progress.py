"""Progress of learners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(progress: DataFrame, least: int = 5, top: int = 10) -> DataFrame:
    """The `top` learners by mastery rate, then mean score, then id, of those with `least` finished concepts or more.

    Learners are aggregated first; only `top` rows are ranked by the window.
    """
    finished = progress.where(F.col("status").isin("completed", "mastered"))
    scores = finished.groupBy("student_id").agg(
        F.count("*").alias("concepts"),
        F.round(F.avg("score") + 1e-12, 6).alias("avg_score"),
        F.round(F.sum(F.when(F.col("status") == "mastered", 1).otherwise(0)) / F.count("*"), 6).alias("mastery_rate"),
    )
    order = [F.col("mastery_rate").desc_nulls_last(), F.col("avg_score").desc_nulls_last(), F.col("student_id").asc_nulls_last()]
    best = scores.where(F.col("concepts") >= least).orderBy(*order).limit(top)
    return best.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "student_id", "concepts", "avg_score", "mastery_rate")


def current_paths(profiles: DataFrame, paths: DataFrame, segments: DataFrame, progress: DataFrame, enough: float = 0.7) -> DataFrame:
    """learner, path_id, state, total_chunks, completed_chunks, percentage: the path that each learner's profile points to.

    profiles (learner, path_id), paths (path_id, learner), segments (path_id, chunk: a chunk counts as often as it is there) and progress
    (learner, chunk, level, at, id: the newest level counts, of one time that of the largest id).  A profile without a pointer has state
    `none`, one whose path is missing or another learner's `not found`; both have no chunks.  Null chunks count as not completed.
    """
    newest = progress.groupBy("learner", "chunk").agg(F.max_by("level", F.struct("at", "id")).alias("level")).where(F.col("level") >= enough)
    own = paths.select("path_id", "learner").distinct().withColumn("found", F.lit(True))
    held = profiles.join(own, ["path_id", "learner"], "left")
    chunks = held.where("found").join(segments, "path_id").join(newest, ["learner", "chunk"], "left")
    counts = chunks.groupBy("learner", "path_id").agg(F.count("*").alias("total"), F.count("level").alias("done"))
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("done", F.lit(0))
    state = F.when(F.col("path_id").isNull(), "none").when(F.col("found"), "active").otherwise("not found")
    percentage = F.when(total > 0, F.round(100.0 * done / total, 4)).otherwise(F.lit(0.0))
    return held.join(counts, ["learner", "path_id"], "left").select("learner", "path_id", state.alias("state"), total.alias("total_chunks"), done.alias("completed_chunks"), percentage.alias("percentage"))
