"""Numbers, neighbours and percentiles over whole tables or large groups without a single task that sorts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(rows: DataFrame, order: str | list[str | Column], name: str, within: str | None = None) -> DataFrame:
    """Adds `name`: 1, 2, ... in this order, over the whole table or in each value of `within` (null is one of them).

    Rows are laid out in ranges of the order and numbered in their own range; what lies before a range is the sum of
    the counts of earlier ones, of which there are as many as tasks.  A group with most rows is spread over many ranges.
    """
    order = [order] if isinstance(order, str) else order
    lead = [within] if within else []
    laid = cut(rows.repartitionByRange(*lead, *order).withColumn("_part", F.spark_partition_id()))
    groups = ["_part", *lead]
    counts = laid.groupBy(*groups).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*(lead or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_p"), *(F.col(c).alias("_w") for c in lead), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    if within:
        on = on & F.col(within).eqNullSafe(F.col("_w"))
    own = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return laid.withColumn("_own", own).join(counts, on).withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_p", "_w", "_before")


def running_sum(rows: DataFrame, value: str, order: str | list[str | Column], name: str, within: str | None = None) -> DataFrame:
    """Adds `name`: the sum of `value` (null counts as 0) up to the row in this order, over the whole table or in each value of `within`.

    `order` is free of ties in a group, or rows that tie are added in any order.  Laid out in ranges as in `numbered`.
    """
    order = [order] if isinstance(order, str) else order
    lead = [within] if within else []
    laid = cut(rows.repartitionByRange(*lead, *order).withColumn("_part", F.spark_partition_id()))
    sums = laid.groupBy("_part", *lead).agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(*(lead or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_p"), *(F.col(c).alias("_w") for c in lead), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_p")
    if within:
        on = on & F.col(within).eqNullSafe(F.col("_w"))
    own = F.sum(value).over(Window.partitionBy("_part", *lead).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return laid.withColumn("_own", own).join(sums, on).withColumn(name, F.coalesce("_own", F.lit(0)) + F.col("_before")).drop("_part", "_own", "_p", "_w", "_before")


def beside(rows: DataFrame, number: str, steps: int, columns: dict[str, str], within: str | None = None) -> DataFrame:
    """Adds columns (new name: old one) of the row that is `steps` later in the numbering; null where there is none."""
    other = rows.select((F.col(number) - steps).alias("_at"), *([F.col(within).alias("_in")] if within else []), *(F.col(old).alias(new) for new, old in columns.items()))
    on = F.col(number) == F.col("_at")
    if within:
        on = on & F.col(within).eqNullSafe(F.col("_in"))
    return rows.join(other.hint("merge"), on, "left").drop("_at", "_in")  # as many rows on both sides: never through the driver


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], within: str | None = None) -> DataFrame:
    """Exact percentiles of the values that are there, between the two nearest; a row, or one for each value of `within`."""
    lead = [within] if within else []
    some = numbered(rows.where(F.col(value).isNotNull()).select(*lead, F.col(value).cast("double").alias("_v")), "_v", "_i", within)
    sizes = some.groupBy(*lead).agg(F.max("_i").alias("_n"))  # a row for each group
    on = F.col(within).eqNullSafe(F.col("_g")) if within else F.lit(True)
    some = some.join(F.broadcast(sizes.select(*(F.col(c).alias("_g") for c in lead), "_n")) if not within else sizes.select(F.col(within).alias("_g"), "_n"), on)
    out = []
    for name, share in shares.items():
        at = (F.col("_n") - 1) * share
        low = F.max(F.when(F.col("_i") - 1 == F.floor(at), F.col("_v")))
        high = F.max(F.when(F.col("_i") - 1 == F.ceil(at), F.col("_v")))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return some.groupBy(*lead).agg(*out)
