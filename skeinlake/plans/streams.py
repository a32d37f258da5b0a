"""Streaming queries; each has the result of the batch query over the same events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as E
from .registry import query


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS chunks, round(sum(value), 3) AS seconds FROM events GROUP BY 1, 2")
def stream_daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.counters(E.source(spark, f"{sf_dir}/events.parquet"), ["user_id"], "1 day", {"chunks": F.count("*"), "seconds": F.round(F.sum("value"), 3)})
    return rows.select("user_id", F.to_date("start").alias("day"), "chunks", "seconds")


@query("SELECT user_id, count(*) AS n, round(avg(value) + 1e-12, 6) AS running_mean, max(value) AS best FROM events GROUP BY 1")
def stream_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.totals(E.source(spark, f"{sf_dir}/events.parquet"), ["user_id"], {"n": F.count("*"), "running_mean": F.round(F.avg("value") + 1e-12, 6), "best": F.max("value")})


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners at or above two failures in a fixed hour."""
    failures = E.source(spark, f"{sf_dir}/events.parquet").where("event_type = 'error'")
    rows = E.counters(failures, ["user_id"], "1 hour", {"attempts": F.count("*")})
    return rows.where("attempts >= 2").select("user_id", F.col("start").cast("timestamp_ntz").alias("hour"), "attempts")


_GAPS = """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {gap} SECOND THEN 0 ELSE 1 END AS new FROM events WHERE {where} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g), s AS (SELECT user_id AS student_id, min(ts) AS start, max(ts) AS finish, count(*) AS events FROM i GROUP BY user_id, island)"""


@query(f"WITH {_GAPS.format(gap=86_400, where='true')} SELECT * FROM s")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that expire a day after their last event."""
    from ..streaming.sessions import sessions

    return sessions(E.source(spark, f"{sf_dir}/events.parquet"), "user_id", 86_400).select(F.col("key").alias("student_id"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("finish").cast("timestamp_ntz").alias("finish"), "events")


@query(f"WITH {_GAPS.format(gap=172_800, where=chr(39).join(['event_type = ', 'error', '']))}, l AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY start DESC) AS place FROM s) SELECT student_id, finish AS last_failure, events AS failures, events >= 3 AS blocked FROM l WHERE place = 1")
def stream_attempt_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that each renew their window of two days; three or more block a learner."""
    from ..streaming.sessions import sessions

    found = sessions(E.source(spark, f"{sf_dir}/events.parquet").where("event_type = 'error'"), "user_id", 172_800)
    last = found.groupBy("key").agg(F.max_by(F.struct("finish", "events"), "start").alias("s"))
    return last.select(F.col("key").alias("student_id"), F.col("s.finish").cast("timestamp_ntz").alias("last_failure"), F.col("s.events").alias("failures"), (F.col("s.events") >= 3).alias("blocked"))


@query("SELECT session, count(*) AS events, string_agg(event_id, ',' ORDER BY event_id) AS event_ids FROM (SELECT event_id, user_id || '@' || CAST(ts AS DATE) AS session, row_number() OVER (ORDER BY event_id DESC) AS place FROM events) WHERE place <= 1000 GROUP BY 1")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by session in the newest thousand: a history that is bounded by a top-k."""
    from .projection import read

    rows = read(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(1000)
    session = F.concat(F.col("user_id").cast("string"), F.lit("@"), F.to_date("ts").cast("string"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: i.cast("string")), ",")
    return rows.groupBy(session.alias("session")).agg(F.count("*").alias("events"), ids.alias("event_ids"))
