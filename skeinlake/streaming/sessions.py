"""Sessions of a key: events no further apart than a gap, whatever order and batches they come in.

The state of a key and a stretch of time as long as the gap is the first and the last time there and the number of events.  What is
left at the end is joined over the stretches: sessions of a key with most of the events are spread over as many states as it has stretches.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import merged
from .events import totals


def absorb(starts: list[int], finishes: list[int], counts: list[int], times: list[int], gap: int) -> tuple[set[int], set[int]]:
    """Puts ascending times into ascending intervals that lie further apart than the gap; starts that changed, and starts that went."""
    changed, gone = set(), set()
    for t in times:
        k = bisect_left(starts, t)  # intervals before k begin earlier
        before = k > 0 and t - finishes[k - 1] <= gap
        after = k < len(starts) and starts[k] - t <= gap
        if before and after:
            finishes[k - 1], counts[k - 1] = max(finishes[k - 1], finishes[k], t), counts[k - 1] + counts[k] + 1
            gone.add(starts[k])
            del starts[k], finishes[k], counts[k]
            changed.add(starts[k - 1])
        elif before:
            finishes[k - 1], counts[k - 1] = max(finishes[k - 1], t), counts[k - 1] + 1
            changed.add(starts[k - 1])
        elif after:
            if starts[k] != t:
                gone.add(starts[k])
            starts[k], counts[k] = t, counts[k] + 1
            changed.add(t)
        else:
            starts.insert(k, t)
            finishes.insert(k, t)
            counts.insert(k, 1)
            changed.add(t)
    return changed & set(starts), gone - set(starts)


def sessions(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """key, start, finish, events of all sessions of a stream with a column `ts`, the open ones as far as they go.

    The result is that of one batch of all events.  Events without a key or a time are left out; repeated rows are events of their own.
    """
    gap = gap_seconds * 1_000_000
    # Events of a stretch of time no longer than the gap are of one session: its first, its last and their number are all that is needed.
    stretch = max(gap, 1)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("long").alias("key"), t.alias("t"), (t - F.pmod(t, F.lit(stretch))).alias("stretch"))
    parts = totals(rows, ["key", "stretch"], {"begin": F.min("t"), "finish": F.max("t"), "events": F.count("*")})
    found = merged(parts, "key", gap, {"events": F.sum("events")})
    return found.select("key", F.timestamp_micros("begin").alias("start"), F.timestamp_micros("finish").alias("finish"), "events")
