"""Footers of Parquet files against the rows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from skeinlake.session import ship
from skeinlake.sources import footers


def test_footers_of_a_folder(spark, tmp_path):
    for k in range(3):
        pq.write_table(pa.table({"a": pa.array([10 * k, None, 10 * k + 5], pa.int64()), "b": ["x", "y", None]}), tmp_path / f"part-{k}.parquet", row_group_size=2)
    rows = footers.footers(ship(spark), {"t": f"file://{tmp_path}"})
    assert rows.count() == 12 and rows.rdd.getNumPartitions() == 3
    found = footers.summary(rows.where("column = 'a'")).collect()
    assert [(r["table"], r["column"], r["type"], r["rows"], r["nulls"], r["least"], r["greatest"]) for r in found] == [("t", "a", "INT64", 9, 3, 0, 25)]
    assert rows.where("table = 'other'").collect() == [] and rows.where("row_group = 1").count() == 6
    some = footers.footers(spark, {"t": f"file://{tmp_path}"}, ["b", "c"])
    assert {r["column"] for r in some.collect()} == {"b"} and some.where("column = 'a'").collect() == []
    assert footers.footers(spark, {"t": f"file://{tmp_path}/part-1.parquet"}).rdd.getNumPartitions() == 1


def test_keys_and_references(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6), (2, None), (None, 9)], "k long, r long")
    assert tuple(footers.key_check(rows, ["k"]).first()) == (4, 2, 1, False)
    assert tuple(footers.key_check(rows, ["k", "r"]).first()) == (4, 2, 2, False)
    assert tuple(footers.key_check(rows.where("r > 0 AND k > 0"), ["k"]).first()) == (2, 2, 0, True)
    assert tuple(footers.reference_check(rows, "r", spark.createDataFrame([(5,), (6,)], "x long"), "x").first()) == (3, 1)
