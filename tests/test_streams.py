"""Streams give the result of one batch of all rows, whatever order and batches they come in."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

from skeinlake.plans import streams
from skeinlake.streaming import sessions

DAYS = (200, 199, 100, 3, 0)


def test_late_rows_count(spark, tmp_path, monkeypatch):
    (tmp_path / "events.parquet").mkdir()
    for k, day in enumerate(DAYS):
        path = tmp_path / "events.parquet" / f"part-{k}.parquet"
        times = [datetime(2024, 1, 1) + timedelta(days=day, minutes=m) for m in (0, 1)]
        pq.write_table(pa.table({"user_id": pa.array([1, 1]), "ts": pa.array(times, pa.timestamp("us")), "event_type": ["error"] * 2, "value": [1.0, 2.0]}), path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    source = streams.E.source
    monkeypatch.setattr(streams.E, "source", lambda spark, path: source(spark, path, 1))
    first = datetime(2024, 1, 1)
    daily = streams.stream_daily_counters(spark, str(tmp_path)).collect()
    assert sorted((r["day"], r["chunks"], r["seconds"]) for r in daily) == sorted(((first + timedelta(days=d)).date(), 2, 3.0) for d in DAYS)
    limits = streams.stream_rate_limit(spark, str(tmp_path)).collect()
    assert sorted((r["hour"], r["attempts"]) for r in limits) == sorted((first + timedelta(days=d), 2) for d in DAYS)


def plain_sessions(times, gap):
    """(start, finish, events) of ascending times."""
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_intervals_take_times_in_any_order():
    rng = random.Random(3)
    for _ in range(200):
        gap, times = rng.randrange(1, 30), [rng.randrange(400) for _ in range(rng.randrange(1, 60))]
        starts, finishes, counts, written = [], [], [], {}
        while times:
            some, times = times[:7], times[7:]
            changed, gone = sessions.absorb(starts, finishes, counts, sorted(some), gap)
            for s in gone:
                written.pop(s, None)
            for s in changed:
                k = starts.index(s)
                written[s] = (s, finishes[k], counts[k])
        assert sorted(written.values()) == list(zip(starts, finishes, counts, strict=True))


def test_sessions_of_batches_in_reverse(spark, tmp_path):
    """One file a batch, the latest first; repeated times, sessions over midnight, one learner with most events."""
    rng = random.Random(5)
    first = datetime(2024, 1, 1)
    rows = sorted(((first + timedelta(minutes=rng.randrange(60 * 24 * 12)), rng.choice([1, 1, 1, 2, 3, None])) for _ in range(400)), key=lambda r: r[0])
    rows += rows[:20]
    (tmp_path / "events.parquet").mkdir()
    for k in range(6):
        path = tmp_path / "events.parquet" / f"part-{k}.parquet"
        some = rows[70 * k : 70 * k + 70]
        pq.write_table(pa.table({"user_id": pa.array([u for _, u in some], pa.int64()), "ts": pa.array([t for t, _ in some], pa.timestamp("us"))}), path)
        os.utime(path, (1_700_000_000 - k, 1_700_000_000 - k))
    (tmp_path / "events.parquet.bak").write_text("not a part of it")
    gap = 3 * 3600
    found = sessions.sessions(streams.E.source(spark, str(tmp_path / "events.parquet"), 1), "user_id", gap).collect()
    want = [(u, s, f, n) for u in (1, 2, 3) for s, f, n in plain_sessions([t for t, v in rows if v == u], timedelta(seconds=gap))]
    assert sorted(tuple(r) for r in found) == want


def test_sessions_without_python_state(spark, tmp_path, monkeypatch):
    """States of sessions are the engine's own; gaps of exactly the limit, a microsecond more, and times before 1970."""
    from pyspark.sql.group import GroupedData

    def refuse(*_args):
        raise AssertionError("a Python call for each learner and day")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", refuse)
    (tmp_path / "events.parquet").mkdir()
    gap, first = timedelta(seconds=60), datetime(1969, 12, 31, 23, 58)
    times = [first]
    for step in (gap, gap, gap + timedelta(microseconds=1), timedelta(0), gap - timedelta(microseconds=1), gap, gap + timedelta(microseconds=1)):
        times.append(times[-1] + step)
    for k in range(2):
        path = tmp_path / "events.parquet" / f"part-{k}.parquet"
        pq.write_table(pa.table({"user_id": pa.array([7] * 4, pa.int64()), "ts": pa.array(times[k::2], pa.timestamp("us"))}), path)
        os.utime(path, (1_700_000_000 - k, 1_700_000_000 - k))
    found = sessions.sessions(streams.E.source(spark, str(tmp_path / "events.parquet"), 1), "user_id", 60).collect()
    assert sorted(tuple(r) for r in found) == [(7, *s) for s in plain_sessions(times, gap)]


def test_attempt_limit_without_python_state(spark, tmp_path, monkeypatch):
    from pyspark.sql.group import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    (tmp_path / "events.parquet").mkdir()
    first = datetime(2024, 1, 1)
    times = [first, first + timedelta(days=2), first + timedelta(days=4), first + timedelta(days=9)]
    pq.write_table(pa.table({"user_id": pa.array([1, 1, 1, 2], pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "event_type": ["error"] * 4}), tmp_path / "events.parquet" / "part-0.parquet")
    got = sorted(tuple(r) for r in streams.stream_attempt_limit(spark, str(tmp_path)).collect())
    assert got == [(1, times[2], 3, True), (2, times[3], 1, False)]
