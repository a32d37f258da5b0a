"""Joins and merges of intervals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def contain_points(intervals: DataFrame, points: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals (begin, finish, exclusive) and points (at) of the same key, the point inside.

    Both are cut into buckets of `width`: a point has one, an interval as many as it touches, so that the join is one
    of equality and no task sees a whole key.  Empty intervals hold nothing; nulls match nothing.
    """
    spread = intervals.where("begin < finish").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("finish") - 1) / width))))
    placed = points.withColumn("_bucket", F.floor(F.col("at") / width))
    return spread.join(placed, [key, "_bucket"]).where("at >= begin AND at < finish").drop("_bucket")


def covering(intervals: DataFrame, points: DataFrame, key: str, width: int, number: str) -> DataFrame:
    """key, at, intervals and first: for each distinct point how many intervals hold it, and the least number of one; points in none are left out.

    Intervals are cut at the bounds of buckets and counted where their pieces are equal, before they meet points: a bucket has as many pieces
    as it has pairs of bounds, however many intervals there are.  Empty intervals hold nothing; nulls match nothing.
    """
    bucket = F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("finish") - 1) / width)))
    cut_to = {"_from": F.greatest(F.col("begin"), F.col("_bucket") * width), "_to": F.least(F.col("finish"), (F.col("_bucket") + 1) * width)}
    pieces = intervals.where("begin < finish").withColumn("_bucket", bucket).withColumns(cut_to).groupBy(key, "_bucket", "_from", "_to").agg(F.count("*").alias("n"), F.min(number).alias("first"))
    placed = points.select(key, "at").distinct().withColumn("_bucket", F.floor(F.col("at") / width))
    return placed.join(pieces, [key, "_bucket"]).where("at >= _from AND at < _to").groupBy(key, "at").agg(F.sum("n").alias("intervals"), F.min("first").alias("first"))


#: Slots of a level that are one of the next.
SLOTS = 64


def containing(outer: DataFrame, inner: DataFrame, key: str, width: int) -> DataFrame:
    """key, begin, finish and inside: for each distinct interval of `outer` (long begin and finish) how many of `inner` lie in it, equal ones too.

    Equal intervals are counted first.  An inner interval lies in the outer one's bucket of `width` begins, or in a later slot: slots of buckets, of
    SLOTS buckets and so on, so that an outer interval asks once for each level, however long it is, and those of one slot and finish ask together.  In a
    bucket sums over slots and finishes answer for all at once, without pairs.  Empty intervals hold nothing and lie in nothing; nulls match nothing.
    """
    columns, valid = [key, "begin", "finish"], F.col(key).isNotNull() & F.expr("begin < finish")
    held, asked = inner.where(valid), outer.where(valid).select(*columns).distinct()
    least, most = outer.where(valid).agg(F.min("begin"), F.max("finish") - 1).first()
    place = lambda c, size: F.floor((c - F.lit(least or 0)) / size)

    def task(wanted: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted) or not len(rows):  # an empty side has no columns
            return wanted[[key, "_slot", "finish"]].assign(inside=0) if len(wanted) else pd.DataFrame(columns=[key, "_slot", "finish", "inside"])
        slots, row = np.unique(rows["_slot"].to_numpy(), return_inverse=True)
        finishes, column = np.unique(rows["_until"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(slots) + 1, len(finishes) + 1), dtype=np.int64)
        np.add.at(sums, (row, column + 1), rows["n"].to_numpy())
        sums = sums[::-1].cumsum(axis=0)[::-1].cumsum(axis=1)  # slots from here on, finishes up to here
        inside = sums[np.searchsorted(slots, wanted["_slot"]), np.searchsorted(finishes, wanted["finish"], side="right")]
        return wanted[[key, "_slot", "finish"]].assign(inside=inside)

    def counts(asks: DataFrame, slot: Column, size: int) -> DataFrame:
        """key, _slot, finish and inside of asks (key, _bucket, _slot, finish): inner intervals from that slot of the bucket on, up to the finish."""
        rows = held.groupBy(key, place(F.col("begin"), size).alias("_bucket"), slot.alias("_slot"), F.col("finish").alias("_until")).agg(F.count("*").alias("n"))
        return asks.groupBy(key, "_bucket").cogroup(rows.groupBy(key, "_bucket")).applyInPandas(task, asks.select(key, "_slot", "finish").schema.add("inside", "long"))

    begin, last = F.col("begin"), F.col("finish") - 1
    found = counts(asked.select(key, place(begin, width).alias("_bucket"), begin.alias("_slot"), "finish"), begin, width).withColumnRenamed("_slot", "begin").select(*columns, "inside")
    while least is not None and width <= most - least:
        later = asked.where(place(begin, width) < place(last, width)).select(*columns, place(begin, width * SLOTS).alias("_bucket"), (place(begin, width) + 1).alias("_slot"))
        sums = counts(later.select(key, "_bucket", "_slot", "finish").distinct(), place(begin, width), width * SLOTS)
        found = found.unionByName(later.join(sums, [key, "_slot", "finish"]).select(*columns, "inside"))
        width *= SLOTS
    return found.groupBy(*columns).agg(F.sum("inside").alias("inside"))


def merged(intervals: DataFrame, key: str, gap: int, sums: dict[str, Column] | None = None) -> DataFrame:
    """key, island, begin, finish, regions and sums: intervals of a key (null is one) with at most `gap` between them as one.

    Intervals of one begin are counted first.  The others are laid out in ranges of key and begin, so that a key with most rows lies in many; a
    range takes over the greatest finish and the number of islands of the key's earlier ranges, of which there is a row each.
    """
    sums = {"regions": F.count("*")} | (sums or {})
    rows = intervals.where("begin IS NOT NULL AND finish IS NOT NULL").groupBy(key, "begin").agg(F.max("finish").alias("finish"), *(c.alias(n) for n, c in sums.items()))
    rows = cut(rows.repartitionByRange(key, "begin").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_part", key).orderBy("begin")
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: Column, fold: Callable[[str], Column]) -> DataFrame:
        """Adds _over, the fold of a value over the key's earlier ranges; null in its first one."""
        each = rows.groupBy("_part", key).agg(value.alias("_value"))
        each = each.select(F.col("_part").alias("_p"), F.col(key).alias("_k"), fold("_value").over(earlier).alias("_over"))
        return rows.join(each, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k"))).drop("_p", "_k")

    rows = carried(rows, F.max("finish"), F.max)
    last = F.greatest(F.max("finish").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.col("_over"))
    rows = cut(rows.withColumn("_new", F.coalesce((F.col("begin") > last + gap).cast("int"), F.lit(1))).drop("_over"))
    rows = carried(rows, F.sum("_new"), F.sum).withColumn("island", F.sum("_new").over(before) + F.coalesce("_over", F.lit(0)))
    return rows.groupBy(key, "island").agg(F.min("begin").alias("begin"), F.max("finish").alias("finish"), *(F.sum(n).alias(n) for n in sums))
