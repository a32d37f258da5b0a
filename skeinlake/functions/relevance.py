"""How results of a search suit a learner: column expressions for re-ranking, types of relevance and words about both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Difficulty that suits each level of learners.
LEVELS = {"beginner": (0.0, 0.4), "intermediate": (0.3, 0.7), "advanced": (0.6, 1.0)}
#: Kinds of chunks that serve an intent.
INTENTS = {"explanation": ("definition", "theory"), "example": ("example", "code"), "practice": ("exercise", "problem"), "theory": ("theory", "mathematical")}


def difficulty_match(difficulty: Column, level: str | None) -> Column:
    """1 in the middle of the level's range, 0 at its ends; outside, 1 less two for each unit of distance."""
    if level is None:
        return F.lit(0.5)
    low, high = LEVELS.get(level, (0.0, 1.0))
    inside = 1 - F.abs(difficulty - (low + high) / 2) / ((high - low) / 2)
    away = F.when(difficulty < low, low - difficulty).otherwise(difficulty - high)
    return F.when(difficulty.between(low, high), inside).otherwise(F.greatest(F.lit(0.0), 1 - away * 2))


def prerequisite_score(prerequisites: Column, history: Column) -> Column:
    """Share of the prerequisites in the history; 1 where there are none."""
    return F.when(F.size(prerequisites) == 0, 1.0).otherwise(F.size(F.array_intersect(prerequisites, history)) / F.size(prerequisites))


def intent_match(kind: Column, intent: str | None) -> Column:
    return F.lit(0.5) if intent is None else F.when(kind.isin(*INTENTS.get(intent, ())), 1.0).otherwise(0.3)


def reranked(score: Column, prerequisites: Column, difficulty: Column, intent: Column) -> Column:
    boost = 0.3 * prerequisites + 0.3 * difficulty + 0.4 * intent
    return F.least(F.lit(1.0), score * (1 + boost * 0.5))


def related_share(concepts: Column, current: Column) -> Column:
    """Share of the current concepts that the result has, null if none."""
    both = F.size(F.array_intersect(concepts, current))
    return F.when(both > 0, both / F.size(current))


def explanation(score: Column, related: Column, concepts: Column, prerequisites: Column) -> Column:
    how = F.when(score > 0.9, "Very high semantic similarity").when(score > 0.8, "High semantic similarity").when(score > 0.7, "Good semantic similarity")
    names = F.when(related.isNotNull() & (F.size(concepts) > 0), F.concat(F.lit("Related concepts: "), F.array_join(F.slice(concepts, 1, 3).cast("array<string>"), ", ")))
    text = F.concat_ws("; ", how, names, F.when(F.size(prerequisites) > 0, "Contains prerequisite information"))
    return F.when(text == "", "Relevant content").otherwise(text)
