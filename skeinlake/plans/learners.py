"""Queries of learner progress: summaries, trends, streaks, upserts, mastery and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import islands, mastery, progress, ranks, upserts
from ..operators.lineage import cut
from .projection import CONCEPTS_SQL, LEARNER_EVENTS_SQL, PREREQUISITES_SQL, learner_events, prerequisites
from .registry import query

_LE = f"WITH {LEARNER_EVENTS_SQL}"
_LATEST_SQL = f"""{_LE}, latest AS (
  SELECT student_id, concept_id, status, score, seconds, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY student_id, concept_id ORDER BY ts DESC, event_id DESC) AS rn FROM learner_events
  ) WHERE rn = 1
)"""


#: Added to means before rounding: ties then round alike, whatever the order of summing was.
NUDGE = 1e-12
#: Added to sums of minutes before they are cut: seconds that are whole minutes stay so, whatever order they were summed in.
WHOLE = 1e-9


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.newest(learner_events(spark, sf_dir), ["student_id", "concept_id"], ["ts", "event_id"])


def _count_if(condition) -> F.Column:
    return F.sum(F.when(condition, 1).otherwise(0))


@query(f"""{_LE},
s AS (
  SELECT student_id, count(*) AS concepts, round(avg(score) + 1e-12, 6) AS avg_score, round(sum(CASE WHEN status = 'mastered' THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS mastery_rate
  FROM learner_events WHERE status IN ('completed', 'mastered') GROUP BY student_id HAVING count(*) >= 5
), r AS (SELECT *, row_number() OVER (ORDER BY mastery_rate DESC, avg_score DESC, student_id) AS place FROM s)
SELECT place, student_id, concepts, avg_score, mastery_rate FROM r WHERE place <= 10""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.leaderboard(learner_events(spark, sf_dir))


@query(f"""{_LE} SELECT student_id, count(*) AS events, count(DISTINCT concept_id) AS concepts, round(avg(score) + 1e-12, 6) AS avg_score, max(score) AS best_score,
  min(score) AS least_score, CAST(sum(CASE WHEN status = 'mastered' THEN 1 ELSE 0 END) AS BIGINT) AS mastered, count(DISTINCT CAST(ts AS DATE)) AS active_days
  FROM learner_events GROUP BY student_id""")
def personal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner_events(spark, sf_dir).groupBy("student_id").agg(
        F.count("*").alias("events"), F.count_distinct("concept_id").alias("concepts"), F.round(F.avg("score") + 1e-12, 6).alias("avg_score"), F.max("score").alias("best_score"),
        F.min("score").alias("least_score"), _count_if(F.col("status") == "mastered").alias("mastered"), F.count_distinct(F.to_date("ts")).alias("active_days"))


@query(f"""{_LATEST_SQL} SELECT student_id, count(DISTINCT concept_id) FILTER (WHERE status = 'mastered') AS mastered, count(DISTINCT concept_id) FILTER (WHERE status = 'completed') AS completed,
  count(DISTINCT concept_id) FILTER (WHERE status = 'in_progress') AS in_progress, round(avg(score) FILTER (WHERE status <> 'not_started') + 1e-12, 6) AS avg_started FROM latest GROUP BY student_id""")
def progress_filter_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A latest row is one per concept already: counting rows needs no distinct.
    return _latest(spark, sf_dir).groupBy("student_id").agg(
        *(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("mastered", "completed", "in_progress")), F.round(F.avg(F.when(F.col("status") != "not_started", F.col("score"))) + 1e-12, 6).alias("avg_started"))


@query(f"{_LATEST_SQL} SELECT status, count(*) AS rows, round(avg(score) + 1e-12, 6) AS avg_score FROM latest GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).groupBy("status").agg(F.count("*").alias("rows"), F.round(F.avg("score") + 1e-12, 6).alias("avg_score"))


@query(f"{_LATEST_SQL} SELECT student_id, concept_id, status, score, seconds, ts FROM latest")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select("student_id", "concept_id", "status", "score", "seconds", "ts")


@query(f"""{_LATEST_SQL}, m AS (
  SELECT student_id, concept_id // 10 AS milestone, count(*) AS total, count(*) FILTER (WHERE status = 'mastered') AS mastered, count(*) FILTER (WHERE status IN ('mastered', 'completed')) AS done
  FROM latest GROUP BY ALL) SELECT *, round(100.0 * done / total, 2) AS percent FROM m""")
def milestone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latest(spark, sf_dir).groupBy("student_id", F.floor(F.col("concept_id") / 10).cast("int").alias("milestone"))
    counts = rows.agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "mastered", 1)).alias("mastered"), F.count(F.when(F.col("status").isin("mastered", "completed"), 1)).alias("done"))
    return counts.withColumn("percent", F.round(F.lit(100.0) * F.col("done") / F.col("total"), 2))


@query(f"""{_LATEST_SQL} SELECT student_id, count(*) AS concepts, CAST(floor(sum(seconds) / 60) AS BIGINT) AS minutes, round(avg(score) + 1e-12, 2) AS avg_score, max(ts) AS last_seen, CAST(date_trunc('day', min(ts)) AS DATE) AS first_day FROM latest GROUP BY student_id""")
def user_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).groupBy("student_id").agg(
        F.count("*").alias("concepts"), F.floor(F.sum("seconds") / 60 + WHOLE).alias("minutes"), F.round(F.avg("score") + 1e-12, 2).alias("avg_score"), F.max("ts").alias("last_seen"), F.to_date(F.min("ts")).alias("first_day"))


_VELOCITY_SQL = f"""{_LE}, velocity AS (
  SELECT student_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT concept_id) FILTER (WHERE status IN ('completed', 'mastered')) AS concepts, round(sum(seconds) / 60, 4) AS minutes
  FROM learner_events WHERE ts >= (SELECT max(ts) FROM learner_events) - INTERVAL 84 DAY GROUP BY ALL)"""


def _velocity(spark: SparkSession, sf_dir: str, weeks: int = 12) -> DataFrame:
    events = learner_events(spark, sf_dir)
    as_of = events.agg(F.max("ts").alias("as_of"))
    recent = events.join(F.broadcast(as_of)).where(F.col("ts") >= F.col("as_of") - F.make_dt_interval(F.lit(7 * weeks)))
    return recent.groupBy("student_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(
        F.count_distinct(F.when(F.col("status").isin("completed", "mastered"), F.col("concept_id"))).alias("concepts"), F.round(F.sum("seconds") / 60, 4).alias("minutes"))


@query(f"{_VELOCITY_SQL} SELECT * FROM velocity")
def weekly_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _velocity(spark, sf_dir)


@query(f"""{_VELOCITY_SQL}, {CONCEPTS_SQL}, done AS (
  SELECT student_id, count(DISTINCT concept_id) AS done FROM learner_events WHERE status IN ('completed', 'mastered') GROUP BY 1
), pace AS (SELECT student_id, avg(concepts) AS per_week FROM velocity GROUP BY 1)
SELECT d.student_id, d.done, round(p.per_week, 6) AS per_week, CAST(ceil(((SELECT count(*) FROM concepts) - d.done) / (p.per_week / 7)) AS BIGINT) AS days_left
FROM done d JOIN pace p USING (student_id) WHERE p.per_week > 0""")
def completion_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .projection import concepts

    done = learner_events(spark, sf_dir).where(F.col("status").isin("completed", "mastered")).groupBy("student_id").agg(F.count_distinct("concept_id").alias("done"))
    pace = _velocity(spark, sf_dir).groupBy("student_id").agg(F.avg("concepts").alias("pace")).where("pace > 0")
    total = concepts(spark, sf_dir).agg(F.count("*").alias("total"))
    return done.join(pace, "student_id").join(F.broadcast(total)).select("student_id", "done", F.round("pace", 6).alias("per_week"), F.ceil((F.col("total") - F.col("done")) / (F.col("pace") / 7)).alias("days_left"))


@query(f"""{_LATEST_SQL}, u AS (SELECT student_id, count(*) AS n, avg(score) AS s, sum(seconds) AS t FROM latest GROUP BY 1),
c AS (SELECT median(n) AS median_n, median(s) AS median_s, median(t) AS median_t, avg(s) AS mean_s FROM u)
SELECT student_id, n AS concepts, round(s + 1e-10, 6) AS avg_score, round(median_n, 6) AS cohort_concepts, round(median_s + 1e-10, 6) AS cohort_score, round(median_t, 4) AS cohort_seconds, round(s / nullif(mean_s, 0) + 1e-10, 6) AS ratio FROM u, c""")
def cohort_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _latest(spark, sf_dir).groupBy("student_id").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.sum("seconds").alias("t"))
    users = cut(users)
    # The three medians in one pass over (measure, value) rows; they are one row, as the mean is.
    values = users.select(F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("value")) for m, c in (("mn", "n"), ("ms", "s"), ("mt", "t"))))).alias("p")).select("p.*")
    medians = ranks.percentiles(values, "value", {"m": 0.5}, "measure").agg(*(F.max(F.when(F.col("measure") == m, F.col("m"))).alias(m) for m in ("mn", "ms", "mt")))
    cohort = users.agg(F.avg("s").alias("mean_s")).join(F.broadcast(medians))
    return users.join(F.broadcast(cohort)).select(
        "student_id", F.col("n").alias("concepts"), F.round(F.col("s") + 1e-10, 6).alias("avg_score"), F.round("mn", 6).alias("cohort_concepts"), F.round(F.col("ms") + 1e-10, 6).alias("cohort_score"),
        F.round("mt", 4).alias("cohort_seconds"), F.round(F.try_divide("s", F.nullif("mean_s", F.lit(0.0))) + 1e-10, 6).alias("ratio"))


_STREAK_SQL = f"""{_LE}, d AS (SELECT DISTINCT student_id, CAST(ts AS DATE) AS day FROM learner_events),
i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY student_id ORDER BY day) AS INTEGER) AS island FROM d),
streaks AS (SELECT student_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM i GROUP BY student_id, island)"""


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.streaks(learner_events(spark, sf_dir).withColumn("day", F.to_date("ts")), "student_id", "day")


@query(f"{_STREAK_SQL} SELECT * FROM streaks")
def streak_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streaks(spark, sf_dir)


@query(f"{_STREAK_SQL} SELECT student_id, max(days) AS best_streak, arg_max(days, last_day) AS current_streak FROM streaks GROUP BY 1")
def streak_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streaks(spark, sf_dir).groupBy("student_id").agg(F.max("days").alias("best_streak"), F.max_by("days", "last_day").alias("current_streak"))


@query(f"{_STREAK_SQL} SELECT student_id, days AS streak FROM streaks WHERE last_day = (SELECT CAST(max(ts) AS DATE) FROM learner_events)")
def streak_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = learner_events(spark, sf_dir).agg(F.to_date(F.max("ts")).alias("today"))
    runs = _streaks(spark, sf_dir)
    return runs.join(F.broadcast(today), runs.last_day == F.col("today")).select("student_id", F.col("days").alias("streak"))


@query(f"{_LE} SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT student_id) AS students, round(avg(score) + 1e-12, 6) AS avg_score FROM learner_events GROUP BY 1")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner_events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.count_distinct("student_id").alias("students"), F.round(F.avg("score") + 1e-12, 6).alias("avg_score"))


@query(f"""{_LE}, d AS (SELECT student_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE status = 'mastered') AS n FROM learner_events GROUP BY 1, 2)
SELECT student_id, day, n AS mastered, CAST(sum(n) OVER (PARTITION BY student_id ORDER BY day) AS BIGINT) AS mastered_so_far FROM d""")
def mastery_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = learner_events(spark, sf_dir).groupBy("student_id", F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("status") == "mastered", 1)).alias("mastered"))
    return days.withColumn("mastered_so_far", F.sum("mastered").over(Window.partitionBy("student_id").orderBy("day")))


@query(f"""{_LE} SELECT student_id, concept_id // 10 AS milestone, round(sum(seconds) / 60, 4) AS minutes, count(DISTINCT concept_id) AS concepts FROM learner_events GROUP BY 1, 2""")
def time_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner_events(spark, sf_dir).groupBy("student_id", F.floor(F.col("concept_id") / 10).cast("int").alias("milestone")).agg(F.round(F.sum("seconds") / 60, 4).alias("minutes"), F.count_distinct("concept_id").alias("concepts"))


@query(f"""{_LE} SELECT concept_id, count(*) AS attempts, round(avg(score) + 1e-12, 6) AS mean, round(stddev_samp(score), 6) AS spread, min(score) AS least, max(score) AS most,
  round(count(*) FILTER (WHERE score < 0.5) * 1.0 / count(*), 6) AS low_share FROM learner_events GROUP BY 1 HAVING count(*) >= 5""")
def difficulty_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learner_events(spark, sf_dir).groupBy("concept_id").agg(
        F.count("*").alias("attempts"), F.round(F.avg("score") + 1e-12, 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("spread"), F.min("score").alias("least"), F.max("score").alias("most"),
        F.round(F.count(F.when(F.col("score") < 0.5, 1)) / F.count("*"), 6).alias("low_share"))
    return rows.where("attempts >= 5")


@query(f"""{_LATEST_SQL} SELECT round(count(*) FILTER (WHERE score >= 0.64) * 1.0 / nullif(count(*), 0), 6) AS retention FROM (
  SELECT student_id, concept_id, max(score) AS score, count(*) AS n FROM learner_events GROUP BY 1, 2 HAVING count(*) > 1)""")
def retention_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = learner_events(spark, sf_dir).groupBy("student_id", "concept_id").agg(F.max("score").alias("score"), F.count("*").alias("n")).where("n > 1")
    return reviewed.agg(F.round(F.try_divide(F.count(F.when(F.col("score") >= 0.8 * 0.8, 1)), F.count("*")), 6).alias("retention"))


@query(f"""{_LE}, o AS (SELECT student_id, concept_id, score, ts, event_id FROM learner_events)
SELECT student_id, concept_id, count(*) AS n, round(avg(score) + 1e-12, 6) AS running_mean, round(sum(seconds), 4) AS total_seconds, max(ts) AS last_reviewed FROM learner_events GROUP BY 1, 2""")
def upsert_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the events meet as an old table and an insert: counts and sums add up, the mean runs on."""
    events = learner_events(spark, sf_dir)
    old, new = (events.where(F.col("event_id") % 2 == k).groupBy("student_id", "concept_id").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("seconds").alias("t"), F.max("ts").alias("at")) for k in (0, 1))
    zero = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0))
    return upserts.accumulate(old, new, ["student_id", "concept_id"], {
        "n": zero("old", "n") + zero("new", "n"),
        "running_mean": F.round((zero("old", "s") + zero("new", "s")) / (zero("old", "n") + zero("new", "n")), 6),
        "total_seconds": F.round(zero("old", "t") + zero("new", "t"), 4),
        "last_reviewed": F.greatest("old.at", "new.at"),
    })


@query(f"""{_LE} SELECT student_id, concept_id, max(score) AS best_score, CASE WHEN max(score) >= 0.8 THEN 'mastered' ELSE 'in_progress' END AS status, min(ts) FILTER (WHERE status IN ('completed', 'mastered')) AS completed_at, count(*) AS attempts FROM learner_events GROUP BY 1, 2""")
def upsert_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score wins, status follows it, the first completion stays."""
    return learner_events(spark, sf_dir).groupBy("student_id", "concept_id").agg(
        F.max("score").alias("best_score"), F.when(F.max("score") >= 0.8, "mastered").otherwise("in_progress").alias("status"),
        F.min(F.when(F.col("status").isin("completed", "mastered"), F.col("ts"))).alias("completed_at"), F.count("*").alias("attempts"))


@query(f"""{_LE} SELECT student_id, concept_id, event_id, round(avg(score) OVER (PARTITION BY student_id, concept_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-12, 6) AS running_mean FROM learner_events""")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("student_id", "concept_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return learner_events(spark, sf_dir).select("student_id", "concept_id", "event_id", F.round(F.avg("score").over(order) + 1e-12, 6).alias("running_mean"))


@query(f"""{_LE}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM learner_events WINDOW w AS (PARTITION BY student_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY student_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)
SELECT student_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS events, count(DISTINCT concept_id) AS concepts, round(avg(score) + 1e-12, 6) AS avg_score FROM s GROUP BY 1, 2""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = islands.gap_sessions(learner_events(spark, sf_dir), "student_id", "ts", 6 * 3600)
    return rows.groupBy("student_id", F.col("session_no").cast("long").alias("session_no")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"), F.count_distinct("concept_id").alias("concepts"), F.round(F.avg("score") + 1e-12, 6).alias("avg_score"))


_MASTERY_SQL = f"""{_LE}, a AS (SELECT max(ts) AS as_of FROM learner_events), m AS (
  SELECT student_id, concept_id, avg(score) AS understanding, count(*) AS reviews, floor((epoch(max(as_of)) - epoch(max(ts))) / 86400) AS days FROM learner_events, a GROUP BY 1, 2),
mastery AS (SELECT student_id, concept_id, reviews, CAST(days AS BIGINT) AS days, round(0.5 * understanding + 0.3 * least(1.0, reviews / 5.0) + 0.2 * exp(-0.1 * days) + 1e-12, 6) AS mastery FROM m)"""


def _mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = learner_events(spark, sf_dir)
    as_of = events.agg(F.max("ts").alias("as_of"))
    rows = events.groupBy("student_id", "concept_id").agg(F.avg("score").alias("u"), F.count("*").alias("reviews"), F.max("ts").alias("last")).join(F.broadcast(as_of))
    days = F.floor((F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400_000_000)
    return rows.withColumn("days", days).select("student_id", "concept_id", "reviews", "days", F.round(mastery.concept_mastery(F.col("u"), F.col("reviews"), F.col("days")) + NUDGE, 6).alias("mastery"))


@query(f"{_MASTERY_SQL} SELECT * FROM mastery")
def mastery_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mastery(spark, sf_dir)


@query(f"""{_MASTERY_SQL} SELECT student_id, concept_id, mastery, days FROM mastery WHERE days >= 7 AND mastery < 0.8""")
def due_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mastery(spark, sf_dir).where("days >= 7 AND mastery < 0.8").select("student_id", "concept_id", "mastery", "days")


@query(f"""{_MASTERY_SQL}, {PREREQUISITES_SQL},
met AS (SELECT m.student_id, p.src AS concept_id, count(*) FILTER (WHERE m.mastery >= 0.56) AS met FROM mastery m JOIN prerequisites p ON p.dst = m.concept_id GROUP BY 1, 2),
need AS (SELECT src AS concept_id, count(*) AS need FROM prerequisites GROUP BY 1)
SELECT met.student_id, concept_id, met, need FROM met JOIN need USING (concept_id) WHERE met >= 0.7 * need AND NOT EXISTS (SELECT 1 FROM mastery m WHERE m.student_id = met.student_id AND m.concept_id = met.concept_id)""")
def new_concepts_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts a learner never studied of whose prerequisites at least seven tenths are known well enough."""
    known, edges = _mastery(spark, sf_dir), prerequisites(spark, sf_dir)
    met = known.join(edges, known.concept_id == edges.dst).groupBy("student_id", F.col("src").alias("concept_id")).agg(F.count(F.when(F.col("mastery") >= 0.56, 1)).alias("met"))
    need = edges.groupBy(F.col("src").alias("concept_id")).agg(F.count("*").alias("need"))
    ready = met.join(need, "concept_id").where(F.col("met") >= F.col("need") * F.lit(0.7))
    return ready.join(known.select("student_id", "concept_id"), ["student_id", "concept_id"], "left_anti").select("student_id", "concept_id", "met", "need")


@query(f"""{_LATEST_SQL}, {PREREQUISITES_SQL}, done AS (SELECT student_id, concept_id FROM latest WHERE status IN ('completed', 'mastered')),
c AS (SELECT l.student_id, l.concept_id, count(p.dst) AS need, count(d.concept_id) AS met FROM latest l LEFT JOIN prerequisites p ON p.src = l.concept_id LEFT JOIN done d ON d.student_id = l.student_id AND d.concept_id = p.dst
  WHERE l.status NOT IN ('completed', 'mastered') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY need DESC, concept_id) AS place FROM c WHERE met = need)
SELECT student_id, concept_id, need, place FROM r WHERE place <= 5""")
def roadmap_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _latest(spark, sf_dir).select("student_id", "concept_id", "status")
    is_done = F.col("status").isin("completed", "mastered")
    done = latest.where(is_done).select("student_id", F.col("concept_id").alias("dst"), F.lit(1).alias("hit"))
    wanted = latest.where(~is_done).join(prerequisites(spark, sf_dir), F.col("concept_id") == F.col("src"), "left")
    counts = wanted.join(done, ["student_id", "dst"], "left").groupBy("student_id", "concept_id").agg(F.count("dst").alias("need"), F.count("hit").alias("met")).where("met = need")
    place = F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("need"), "concept_id"))
    return counts.withColumn("place", place.cast("long")).where("place <= 5").select("student_id", "concept_id", "need", "place")


@query(f"""{_LE}, RECURSIVE_MARK AS (SELECT 1), r AS (SELECT student_id, concept_id, CAST(floor(score * 5) AS INTEGER) AS q, row_number() OVER (PARTITION BY student_id, concept_id ORDER BY ts, event_id) AS i FROM learner_events WHERE score IS NOT NULL),
s AS (
  SELECT student_id, concept_id, i, greatest(1.3, 2.5 + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))::DOUBLE AS ease, CASE WHEN q < 3 THEN 0 ELSE 1 END AS repetitions, 1 AS interval_days FROM r WHERE i = 1
  UNION ALL
  SELECT r.student_id, r.concept_id, r.i, greatest(1.3, s.ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))::DOUBLE, CASE WHEN q < 3 THEN 0 ELSE s.repetitions + 1 END,
    CASE WHEN q < 3 OR s.repetitions = 0 THEN 1 WHEN s.repetitions = 1 THEN 6 ELSE CAST(floor(s.interval_days * greatest(1.3, s.ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))) AS INTEGER) END
  FROM s JOIN r ON r.student_id = s.student_id AND r.concept_id = s.concept_id AND r.i = s.i + 1
)
SELECT student_id, concept_id, round(arg_max(ease, i), 6) AS ease, CAST(arg_max(repetitions, i) AS BIGINT) AS repetitions, CAST(arg_max(interval_days, i) AS BIGINT) AS interval_days FROM s GROUP BY 1, 2""".replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE_MARK AS (SELECT 1)", ""))
def sm2_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastery.sm2(learner_events(spark, sf_dir), ["student_id", "concept_id"], ["ts", "event_id"], "score").withColumn("ease", F.round("ease", 6))


@query(f"""{_LATEST_SQL} SELECT student_id, concept_id, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' WHEN score >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM latest""")
def grade_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select("student_id", "concept_id", mastery.grade(F.col("score")).alias("grade"))


@query(f"""{_LE}, u AS (SELECT student_id, concept_id, max(score) * 100 AS score, count(*) AS attempts FROM learner_events GROUP BY 1, 2)
SELECT student_id, concept_id, attempts, CASE WHEN score >= 90 AND attempts <= 2 THEN 'expert' WHEN score >= 80 THEN 'proficient' WHEN score >= 70 THEN 'competent' WHEN score >= 60 THEN 'developing' ELSE 'beginner' END AS level FROM u""")
def mastery_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learner_events(spark, sf_dir).groupBy("student_id", "concept_id").agg((F.max("score") * 100).alias("score"), F.count("*").alias("attempts"))
    return rows.select("student_id", "concept_id", "attempts", mastery.level(F.col("score"), F.col("attempts")).alias("level"))


@query(f"""{_LE}, t AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM learner_events) SELECT event_id, student_id, concept_id, status, ts FROM t WHERE rn <= 20""")
def recent_activity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner_events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "student_id", "concept_id", "status", "ts")


@query(f"""{_LE}, l AS (SELECT student_id, concept_id, max(ts) AS last FROM learner_events GROUP BY 1, 2), a AS (SELECT max(ts) AS as_of FROM learner_events)
SELECT student_id, concept_id, CASE WHEN d < 1 THEN 0.2 WHEN d < 3 THEN 0.5 WHEN d < 7 THEN 0.8 WHEN d < 14 THEN 0.9 ELSE 1.0 END::DOUBLE AS recency FROM (SELECT *, (epoch(as_of) - epoch(last)) / 86400 AS d FROM l, a)""")
def recency_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = learner_events(spark, sf_dir)
    rows = events.groupBy("student_id", "concept_id").agg(F.max("ts").alias("last")).join(F.broadcast(events.agg(F.max("ts").alias("as_of"))))
    d = (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400_000_000
    return rows.select("student_id", "concept_id", F.when(d < 1, 0.2).when(d < 3, 0.5).when(d < 7, 0.8).when(d < 14, 0.9).otherwise(1.0).alias("recency"))


@query(f"""{_MASTERY_SQL}, c AS (
  SELECT student_id, concept_id, 0 AS tier, mastery FROM mastery WHERE days >= 7 AND mastery < 0.8
  UNION ALL SELECT student_id, concept_id, 1, mastery FROM mastery WHERE NOT (days >= 7 AND mastery < 0.8) AND mastery < 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY tier, mastery, concept_id) AS place FROM c)
SELECT student_id, concept_id, tier, place FROM r WHERE place <= 10""")
def adaptive_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due reviews first, then what is in progress, the weakest first, ten for each learner."""
    rows = _mastery(spark, sf_dir).where("mastery < 0.8").withColumn("tier", F.when(F.col("days") >= 7, 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("student_id").orderBy("tier", "mastery", "concept_id"))
    return rows.withColumn("place", place.cast("long")).where("place <= 10").select("student_id", "concept_id", "tier", "place")
