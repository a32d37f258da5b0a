"""Mastery, spaced repetition and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of mastery bands and grades.
GRADES = ((0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D"))


def concept_mastery(understanding: Column, reviews: Column, days: Column) -> Column:
    """Half understanding, three tenths repetition (full at five reviews), a fifth recency (decaying by a tenth a day)."""
    return 0.5 * understanding + 0.3 * F.least(F.lit(1.0), reviews / 5) + 0.2 * F.exp(-0.1 * days)


def grade(score: Column) -> Column:
    out = F.lit("F")
    for limit, name in reversed(GRADES):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def level(score: Column, attempts: Column) -> Column:
    """expert needs few attempts as well; scores are percentages."""
    return F.when((score >= 90) & (attempts <= 2), "expert").when(score >= 80, "proficient").when(score >= 70, "competent").when(score >= 60, "developing").otherwise("beginner")


def sm2(reviews: DataFrame, keys: list[str], order: list[str], performance: str) -> DataFrame:
    """Spaced-repetition state after all reviews of each key: ease, repetitions, interval_days.

    A grade is five times the performance, cut to an integer; ease changes before the test for failure (grade under 3)
    and is 1.3 at least; intervals are 1, 6, then the last one times ease.  The fold is sequential for each key: the
    reviews of one learner and concept, of which there are few, are an array that the JVM folds.
    """
    grade = F.floor(F.col(performance) * 5).cast("int")
    history = reviews.where(F.col(performance).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, grade.alias("q")))).alias("h"))
    begin = F.struct(F.lit(2.5).alias("ease"), F.lit(0).cast("long").alias("repetitions"), F.lit(0).cast("long").alias("interval_days"))

    def step(state: Column, review: Column) -> Column:
        lacking = 5 - review["q"]
        ease = F.greatest(F.lit(1.3), state["ease"] + 0.1 - lacking * (0.08 + lacking * 0.02))
        passed, before = review["q"] >= 3, state["repetitions"]
        interval = F.when(~passed | (before == 0), 1).when(before == 1, 6).otherwise(F.floor(state["interval_days"] * ease)).cast("long")
        return F.struct(ease.alias("ease"), F.when(passed, before + 1).otherwise(0).cast("long").alias("repetitions"), interval.alias("interval_days"))

    return history.select(*keys, F.aggregate("h", begin, step).alias("s")).select(*keys, "s.ease", "s.repetitions", "s.interval_days")
