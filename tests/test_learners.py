"""Queries of learners on events that the generated tables hardly have."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from tests.test_queries import SQL, rows_of


def compared(spark, folder, duck_sql, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    want = con.execute(duck_sql)
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, str(folder))
    return rows_of(got.columns, got.collect()), rows_of(columns, want.fetchall())


def write(folder, rows):
    user, times, values, kinds = zip(*rows, strict=True)
    pq.write_table(pa.table({"event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "user_id": pa.array(user, pa.int64()), "event_type": ["view"] * len(rows),
                             "value": pa.array(values, pa.float64()), "props": [f'{{"k": {k}}}' for k in kinds]}), folder / "events.parquet")


#: The newest event, and others of the same second of earlier days, a part of a second before and after it.
_SECONDS = [(1, datetime(2024, 1, 30, 12, 0, 0, 200_000), 50.0, 1), (2, datetime(2024, 1, 20, 12, 0, 0, 700_000), 50.0, 1), (3, datetime(2024, 1, 20, 12, 0, 0, 100_000), 50.0, 1), (4, datetime(2024, 1, 23, 12, 0, 0, 900_000), 20.0, 2)]


def test_days_of_mastery_by_parts_of_a_second(spark, tmp_path):
    write(tmp_path, _SECONDS)
    got, want = compared(spark, tmp_path, SQL["mastery_score"], "mastery_score")
    assert got == want
    days = {r["student_id"]: r["days"] for r in entry.queries()["mastery_score"](spark, str(tmp_path)).collect()}
    assert days == {1: 0, 2: 9, 3: 10, 4: 6}


def test_due_reviews_by_parts_of_a_second(spark, tmp_path):
    """A learner's concept that is a part of a second short of seven days is not due."""
    write(tmp_path, [(1, datetime(2024, 1, 30, 12, 0, 0, 200_000), 50.0, 1), (4, datetime(2024, 1, 23, 12, 0, 0, 900_000), 20.0, 2), (5, datetime(2024, 1, 23, 12, 0, 0, 200_000), 20.0, 2)])
    got, want = compared(spark, tmp_path, SQL["due_reviews"], "due_reviews")
    assert got == want
    assert [r["student_id"] for r in entry.queries()["due_reviews"](spark, str(tmp_path)).collect()] == [5]


def test_whole_minutes_stay_whole(spark, tmp_path):
    """Seconds that are a minute together, but less in any order of summing floating-point numbers."""
    write(tmp_path, [(1, datetime(2024, 1, 1 + k), v, k) for k, v in enumerate((7.9, 1.36, 18.08, 32.66))] + [(2, datetime(2024, 1, 1), 59.99, 1)])
    minutes = {r["student_id"]: r["minutes"] for r in entry.queries()["user_overview"](spark, str(tmp_path)).collect()}
    assert minutes == {1: 1, 2: 0}
