"""Weighted factors of recommendations, the reason they give, and diversity of what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the factors.
WEIGHTS = {"content": 0.25, "collaborative": 0.2, "prerequisite": 0.2, "difficulty": 0.15, "recency": 0.1, "diversity": 0.1}
#: What a repeated topic's score is multiplied by.
REPEATED = 0.7


#: Factors of fixed steps: their weighted scores are decimals, such as 0.08, without a trace of the product.
STEPS = ("recency", "diversity")


def weighted(factor: str) -> Column:
    product = F.col(factor) * WEIGHTS[factor]
    return F.round(product, 6) if factor in STEPS else product


def six(x: Column) -> Column:
    """Rounded to six digits as SQL engines do: x times a million is rounded, not the digits that x is written with."""
    return F.round(x * 1_000_000, 0) / 1_000_000


def reasons() -> Column:
    """The factor with the largest weighted score; of equal ones, the first."""
    names = list(WEIGHTS)
    best = F.greatest(*(F.struct(weighted(f).alias("w"), F.lit(-k).alias("k")) for k, f in enumerate(names)))
    return F.element_at(F.array(*(F.lit(n) for n in names)), 1 - best["k"])


def diverse(rows: DataFrame, key: str, topic: str, least: float = 0.8) -> DataFrame:
    """Of ranked rows (place, score), the first of each topic; others are kept above `least` after a deduction."""
    nth = F.row_number().over(Window.partitionBy(key, topic).orderBy("place"))
    rows = rows.withColumn("_nth", nth).withColumn("score", F.when(F.col("_nth") == 1, F.col("score")).otherwise(F.col("score") * REPEATED))
    return rows.where((F.col("_nth") == 1) | (F.col("score") > least)).drop("_nth")
