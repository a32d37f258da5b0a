"""Joins give no more rows than their inputs and results need, and what the SQL gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from tests.test_queries import SQL, rows_of


def compared(spark, folder, name, most_rows):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    df = entry.queries()[name](spark, str(folder))
    rows, most = most_rows(df)
    assert rows_of(df.columns, rows) == rows_of(columns, want.fetchall())
    return rows, most


def write(folder, name, **columns):
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def test_best_chunk_of_many(spark, tmp_path, most_rows):
    """Hundreds of chunks of a concept for hundreds of learners: a row for each learner, not one for each pair."""
    rng, n = random.Random(4), 300
    write(tmp_path, "events", event_id=pa.array(range(n), pa.int64()), ts=pa.array([datetime(2024, 1, 1) + timedelta(hours=rng.randrange(700)) for _ in range(n)], pa.timestamp("us")), user_id=pa.array(range(n), pa.int64()),
          event_type=["view"] * n, value=pa.array([rng.randrange(12_000) / 100 for _ in range(n)], pa.float64()), props=[f'{{"k": {k % 3}}}' for k in range(n)])
    docs = [100 * k + rng.randrange(2) for k in range(400)]
    write(tmp_path, "documents", doc_id=pa.array(docs, pa.int64()), text=[" ".join(["word"] * rng.randrange(900)) if k % 9 else None for k in range(400)], n_chars=pa.array(range(400), pa.int64()))
    rows, most = compared(spark, tmp_path, "best_chunk", most_rows)
    assert len(rows) > 50 and most <= 400


def stays(folder, rng, n=1500):
    """Orders of one book, some of them twice or without a customer, with overlapping times; events of the book."""
    day = lambda k: datetime(1992, 1, 1) + timedelta(days=k)
    keys = [k if k % 50 else 10 * (k // 100) for k in range(n)]
    write(folder, "orders", o_orderkey=pa.array(keys, pa.int64()), o_custkey=pa.array([None if k % 97 == 0 else 40 for k in range(n)], pa.int64()), o_orderdate=pa.array([day(rng.randrange(300)) for _ in range(n)], pa.timestamp("us")))
    write(folder, "lineitem", l_orderkey=pa.array(range(n), pa.int64()), l_shipdate=pa.array([day(rng.randrange(320)) for _ in range(n)], pa.timestamp("us")))
    write(folder, "events", event_id=pa.array([5 * k for k in range(n)], pa.int64()), user_id=pa.array([80] * n, pa.int64()))


def test_intervals_make_no_pairs(spark, tmp_path, most_rows):
    stays(tmp_path, random.Random(9))
    rows, most = compared(spark, tmp_path, "intervals_in_intervals", most_rows)
    assert len(rows) > 100 and most < 5000


def test_intervals_of_any_number(spark, tmp_path, most_rows):
    """Intervals whose numbers are not divisible by ten are asked for as well, over several levels of buckets."""
    rng, n, day = random.Random(6), 900, lambda k: datetime(1992, 1, 1) + timedelta(days=k)
    write(tmp_path, "orders", o_orderkey=pa.array(range(1, n + 1), pa.int64()), o_custkey=pa.array([40 + k % 3 for k in range(n)], pa.int64()), o_orderdate=pa.array([day(rng.randrange(-9000, 9000)) for _ in range(n)], pa.timestamp("us")))
    write(tmp_path, "lineitem", l_orderkey=pa.array(range(1, n + 1), pa.int64()), l_shipdate=pa.array([day(rng.randrange(-9000, 9000)) for _ in range(n)], pa.timestamp("us")))
    rows, most = compared(spark, tmp_path, "intervals_in_intervals", most_rows)
    assert sum(r["id"] % 10 != 0 for r in rows) > 400 and most < 5000


def test_points_make_no_pairs(spark, tmp_path, most_rows):
    stays(tmp_path, random.Random(8), 9000)
    rows, most = compared(spark, tmp_path, "points_in_intervals", most_rows)
    assert len(rows) > 500 and most < 300_000  # pairs are 2.3 million


def test_points_of_any_number(spark, tmp_path, most_rows):
    """Events whose numbers are not divisible by five are points too."""
    stays(tmp_path, random.Random(7))
    write(tmp_path, "events", event_id=pa.array(range(1, 1200, 3), pa.int64()), user_id=pa.array([80] * 400, pa.int64()))
    rows, _ = compared(spark, tmp_path, "points_in_intervals", most_rows)
    assert sum(r["event_id"] % 5 != 0 for r in rows) > 50


def test_tickets_of_a_set_that_many_want(spark, tmp_path, most_rows):
    """Learners who want the same concepts are one question."""
    n, rng = 400, random.Random(3)
    write(tmp_path, "customer", c_custkey=pa.array([200 * k + 3 * (k % 2) for k in range(n)], pa.int64()))
    rows = [(k, c) for k in range(300) for c in (3, 21, rng.randrange(30))[: rng.randrange(1, 4)]]
    rows = [r for r in rows if r[0] < 5 or r[1] not in (21, 0)]  # few tickets have all concepts
    write(tmp_path, "lineitem", l_orderkey=pa.array([t for t, _ in rows], pa.int64()), l_partkey=pa.array([c for _, c in rows], pa.int64()))
    rows, most = compared(spark, tmp_path, "tickets_with_all_concepts", most_rows)
    assert 0 < len(rows) <= 2500 and most <= 3000
