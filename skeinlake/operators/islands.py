"""Runs of consecutive days and sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def streaks(activity: DataFrame, who: str, day: str) -> DataFrame:
    """who, first_day, last_day and days of each run of consecutive days."""
    days = activity.select(who, F.col(day).alias("d")).distinct()
    number = F.row_number().over(Window.partitionBy(who).orderBy("d"))
    runs = days.withColumn("island", F.date_sub("d", number))
    return runs.groupBy(who, "island").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("days")).drop("island")


def gap_sessions(events: DataFrame, who: str, ts: str, gap_seconds: int) -> DataFrame:
    """Events with session_no: a new session begins after a gap of more than `gap_seconds`."""
    order = Window.partitionBy(who).orderBy(ts, "event_id")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(order)
    starts = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_new", starts).withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
