"""Quality of chunks' vectors and texts as scores between 0 and 1: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V
from .prose import TEACHING, WORD
from .structure import clamped

#: Weights of teaching, of meaning and of technical scores, and how sure each score is.
WEIGHTS = {"semantic": 0.8 * 0.4, "usage": 0.9 * 0.3, "teaching": 0.7 * 0.3, "kind": 0.8 * 0.3}
MATH_SYMBOLS = "∫∑∂∇π≈≠≤≥±∞√"


def spread(v: Column) -> Column:
    return F.sqrt(V.central_moment(v, 2))


def percentile(v: Column, share: float) -> Column:
    """Of the values of an array, between the two nearest."""
    s = F.array_sort(v)
    at = (F.size(s) - 1) * share
    low, high = F.element_at(s, F.floor(at).cast("int") + 1), F.element_at(s, F.ceil(at).cast("int") + 1)
    return low + (high - low) * (at - F.floor(at))


def entropy(v: Column, bins: int = 50) -> Column:
    """Of the densities in equal bins between the least and the largest value; negative for narrow spreads, 0 for equal values."""
    d = V.as_double(v)
    # The bounds are elements of an array, which is made once: in the functions below they would be looked for again for each value.
    bounds = F.struct(d.alias("d"), F.array_min(d).alias("low"), ((F.array_max(d) - F.array_min(d)) / bins).alias("width"))

    def places(b: Column) -> Column:
        return F.struct(b["width"].alias("width"), F.transform(b["d"], lambda x: F.least(F.floor(F.try_divide(x - b["low"], b["width"])), F.lit(bins - 1))).alias("place"))

    def sums(b: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(b["place"], lambda p: p == k)))
        density = F.transform(F.filter(counts, lambda c: c > 0), lambda c: c / (F.size(b["place"]) * b["width"]))
        return F.when(b["width"] == 0, F.lit(0.0)).otherwise(-V.total(F.transform(density, lambda x: x * F.log2(x))))

    return F.transform(F.transform(F.array(bounds), places), sums)[0]


def reduced(v: Column, share: float = 0.8) -> Column:
    """The values of largest magnitude, in ascending order of it."""
    d = F.array_sort(F.transform(V.as_double(v), lambda x, i: F.struct(F.abs(x).alias("m"), i.alias("i"), x.alias("x"))))
    keep = F.floor(F.size(d) * share).cast("int")
    return F.transform(F.slice(d, F.size(d) - keep + 1, keep), lambda s: s["x"])


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def _any(low: Column, *marks: str) -> Column:
    return F.coalesce(*(F.when(low.contains(m), F.lit(True)) for m in marks), F.lit(False))


def _points(**conditions: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for condition, points in conditions.values():
        total = total + F.when(condition, points).otherwise(0.0)
    return total


def semantic(norm: Column, deviation: Column, n: Column) -> Column:
    return clamped(0.8 - F.when(norm < 0.5, 0.2).when(norm > 2, 0.1).otherwise(0.0) - F.when(deviation < 0.1, 0.3).when(deviation > 1, 0.1).otherwise(0.0) - F.when(n < 5, 0.2).when(n > 500, 0.1).otherwise(0.0))


def usage(used: Column, above_mean: Column) -> Column:
    return clamped(0.7 + F.when(used > 0.8, 0.2).when(used < 0.3, -0.3).otherwise(0.0) + F.when(above_mean.between(0.1, 0.4), 0.1).otherwise(0.0))


def difficulty_signal(variance: Column, difficulty: Column) -> Column:
    expected = 0.1 + difficulty * 0.2
    return clamped(1 - F.abs(variance - expected) / expected)


def magnitude_signal(v: Column) -> Column:
    sizes = F.transform(V.as_double(v), lambda x: F.abs(x))
    limit = percentile(sizes, 0.8)
    return F.least(F.lit(1.0), F.size(F.filter(sizes, lambda x: x > limit)) / F.size(sizes) * 2)


def teaching(text: Column, kind: Column, n: Column, placed: Column, signal: Column) -> Column:
    low = F.lower(text)
    definition = F.when(_any(low, "definition", "define", "is a", "is defined as"), 0.2).otherwise(0.0) - F.when(n < 10, 0.1).otherwise(0.0)
    example = F.when(_any(low, "example", "exercise", "problem", "solution"), 0.2).otherwise(0.0) + F.when(low.contains("solution") & low.contains("example"), 0.1).otherwise(0.0)
    math = F.when(text.rlike(f"[{MATH_SYMBOLS}$=]"), 0.2).otherwise(0.0)
    own = F.when(kind == "definition", definition).when(kind == "example", example).when(kind == "math", math).otherwise(0.0)
    return clamped(0.7 + own + F.when(placed, 0.05).otherwise(0.0) + 0.1 * signal)


def of_kind(text: Column, kind: Column, n: Column, signal: Column) -> Column:
    """How well a formula, a definition or an example keeps what it is; null for other texts."""
    low = F.lower(text)
    math = _points(symbols=(text.rlike(f"[{MATH_SYMBOLS}]"), 0.2), latex=(text.rlike(r"[$\\]"), 0.2), equations=(text.contains("=") & text.rlike("[0-9]"), 0.1)) + 0.1 * signal
    definition = _points(marked=(_any(low, "definition", "define", "is defined as", "is a"), 0.2), explained=(text.contains("."), 0.1), shown=(_any(low, "example", "for instance", "such as"), 0.1))
    definition = definition + F.when(n > 15, 0.1).when(n < 5, -0.2).otherwise(0.0)
    marked, solved = _any(low, "example", "exercise", "problem"), _any(low, "solution", "answer", "result")
    steps = F.size(F.filter(F.split(text, r"\."), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))) > 2
    example = _points(marked=(marked, 0.2), solved=(solved, 0.2), steps=(steps, 0.1), whole=(marked & solved, 0.1))
    return F.when(kind == "math", clamped(0.6 + math)).when(kind == "definition", clamped(0.6 + definition)).when(kind == "example", clamped(0.6 + example))


def overall(scores: dict[str, Column]) -> Column:
    """Weighted mean of the scores that are there."""
    top, weight = F.lit(0.0), F.lit(0.0)
    for name, c in scores.items():
        top, weight = top + F.coalesce(c, F.lit(0.0)) * WEIGHTS[name], weight + F.when(c.isNotNull(), WEIGHTS[name]).otherwise(0.0)
    return top / F.greatest(weight, F.lit(0.001))


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def indicators(text: Column) -> Column:
    return F.size(F.filter(F.array(*(F.lit(t) for t in TEACHING)), lambda t: F.lower(text).contains(t)))
