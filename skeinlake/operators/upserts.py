"""Inserts that meet existing rows, as joins and aggregations over whole tables (append-only inputs, no row-wise writes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key: union of old and new rows is the caller's; aggregation combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per key of both tables; `rules` gives each column from the aliases `old` and `new`."""
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    joined = old.alias("old").join(new.alias("new"), on, "full")
    return joined.select(*(F.coalesce(F.col(f"new.{k}"), F.col(f"old.{k}")).alias(k) for k in keys), *(rule.alias(name) for name, rule in rules.items()))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose keys are not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def unpivot_attributes(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, name, value) rows of attributes as text; nulls give no row."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names)))
    return rows.select(key, pairs.alias("p")).select(key, "p.name", "p.value").where(F.col("value").isNotNull())


def pivot_attributes(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One column per name; the names are given, so that no job looks for them."""
    return rows.groupBy(key).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))
