"""Operators against plain Python: numbers and neighbours, percentiles, intervals, components, levels, sessions, spaced repetition, exports."""

from __future__ import annotations

import datetime
import random
import re
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from skeinlake.operators import concepts, exports, graph, intervals, mastery, progress, ranks
from skeinlake.streaming.sessions import sessions


def test_numbers_and_neighbours(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["hot", "hot", "hot", "cold", None])) for k in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(9)
    got = {r["k"]: (r["n"], r["after"]) for r in ranks.beside(ranks.numbered(df, "k", "n", "g"), "n", 2, {"after": "k"}, "g").collect()}
    groups = defaultdict(list)
    for k, g in sorted(rows):
        groups[g].append(k)
    want = {k: (i + 1, some[i + 2] if i + 2 < len(some) else None) for some in groups.values() for i, k in enumerate(some)}
    assert got == want
    assert {r["k"]: r["n"] for r in ranks.numbered(df, "k", "n").collect()} == {k: i + 1 for i, (k, _) in enumerate(sorted(rows))}
    assert ranks.numbered(df.where("k < 0"), "k", "n", "g").collect() == []


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([None, 0, 1, 5, -3])) for k in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(9)
    totals, want = defaultdict(int), {}
    for k, g, v in sorted(rows, key=lambda r: r[0]):
        totals[g] += v or 0
        want[k] = totals[g]
    assert {r["k"]: r["s"] for r in ranks.running_sum(df, "v", "k", "s", "g").collect()} == want
    assert {r["k"]: r["s"] for r in ranks.running_sum(df.drop("g"), "v", "k", "s").collect()} == {k: sum(v or 0 for j, _, v in rows if j <= k) for k, _, _ in rows}
    assert ranks.running_sum(df.where("k < 0"), "v", "k", "s", "g").collect() == []


def plain_concepts(text):
    """The forms as they are told, one after the other over the text."""
    forms = [r"\b(?:Definition|Theorem|Lemma|Corollary|Proposition|Example|Algorithm|Concept)\s*\d*\.?\d*:?\s*([^\n]+)", r"\b(?:Key Concept|Important Concept|Main Idea):\s*([^\n]+)", r"^(\d+\.\d+\.\d+)\s+([^\n]+)$"]
    found = {}
    for form in forms:
        for m in re.finditer(form, text, re.I | re.M | re.A):
            name = re.sub(r"\s+", " ", m.group(1).strip())[:100]
            if name:
                found.setdefault(name, m.start())
    some = sorted((at, name) for name, at in found.items())
    ends = [at for at, _ in some[1:]] + [len(text)] * bool(some)
    return [(k + 1, name, at, end) for k, ((at, name), end) in enumerate(zip(some, ends, strict=True))][:10]


def test_introduced_concepts(spark):
    rng = random.Random(9)
    parts = ["Definition", "theorem ", "Lemma 3.1: ", "Example", "EXAMPLE 12", "Key Concept: ", "main idea:", "concept", "1.2.3 ", "\n1.2.3 Trees", "\n4.5 no\n", "Graphs", "  ", "\n", "\n\n", "Ä x ", ".", ":", "7", "\r\n", "examples "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["", "plain", "Example", "Example 12", "Definition: " + "long " * 40 + "\nTheorem " + "long " * 40, "\n".join(f"Lemma {k}: thing {k}" for k in range(30)), "Example" + "\n" * 200_000]
    rows = [(i, None if i % 5 == 0 else i % 3, t, "x") for i, t in enumerate(texts)] + [(-1, 0, None, "x")]
    df = spark.createDataFrame(rows, "book long, part long, text string, concept string")
    got = defaultdict(list)
    for r in concepts.introduced(df, ["book", "part"]).orderBy("book", "place").collect():
        got[r["book"]].append(tuple(r)[2:])
    assert got == {i: want for i, t in enumerate(texts) if (want := plain_concepts(t[:5000]))}
    assert concepts.introduced(df.where("book > 1000000"), ["book", "part"]).collect() == []


def test_current_paths(spark):
    rng = random.Random(10)
    profiles = [(k, rng.choice([None, *range(12)])) for k in range(40)]
    paths = [(p, k) for p in range(10) for k in rng.sample(range(40), 25)] * 2
    segments = [(rng.randrange(9), rng.choice([None, *range(6)])) for _ in range(40)]
    levels = [(rng.randrange(40), rng.randrange(6), rng.choice([0.1, 0.69, 0.7, 0.9]), rng.randrange(3), i) for i in range(300)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = progress.current_paths(frame(profiles, "learner long, path_id long"), frame(paths, "path_id long, learner long"), frame(segments, "path_id long, chunk long"), frame(levels, "learner long, chunk long, level double, at long, id long"))
    newest, want = {}, {}
    for k, c, level, at, i in sorted(levels, key=lambda r: (r[3], r[4])):
        newest[k, c] = level
    for k, p in profiles:
        state = "none" if p is None else "active" if (p, k) in paths else "not found"
        own = [c for q, c in segments if q == p] if state == "active" else []
        done = sum(newest.get((k, c), 0) >= 0.7 for c in own)
        want[k] = (p, state, len(own), done, round(100 * done / len(own), 4) if own else 0.0)
    assert {r["learner"]: tuple(r)[1:] for r in got.collect()} == want
    assert {w[1] for w in want.values()} == {"none", "active", "not found"} and any(w[3] for w in want.values())


def test_percentiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)])) for _ in range(500)] + [("c", 7)]
    got = {r["g"]: (r["low"], r["high"]) for r in ranks.percentiles(spark.createDataFrame(rows, "g string, v int"), "v", {"low": 0.37, "high": 0.9}, "g").collect()}
    for g in "abc":
        own = [v for h, v in rows if h == g and v is not None]
        assert np.allclose(got[g], np.percentile(own, [37, 90]))


def test_points_in_intervals(spark):
    rng = random.Random(5)
    spans = [(i, rng.randrange(3), a := rng.randrange(500), a + rng.randrange(0, 200)) for i in range(80)]
    points = [(i, rng.randrange(3), rng.randrange(-20, 720)) for i in range(200)]
    found = intervals.contain_points(spark.createDataFrame(spans, "id int, key int, begin long, finish long"), spark.createDataFrame(points, "point int, key int, at long"), "key", 64)
    want = sorted((s, p) for s, k, a, b in spans for p, h, x in points if k == h and a <= x < b)
    assert sorted((r["id"], r["point"]) for r in found.select("id", "point").collect()) == want


def test_components_and_levels(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    both = edges + [(b, a) for a, b in edges]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(both, "src long, dst long")).collect()}
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {n: find(n) for n in root}
    down = [(k, k // 2) for k in range(1, 60)] + [(k, k - 1) for k in range(10, 20)]
    level = {r["node"]: r["level"] for r in graph.levels(spark.createDataFrame(down, "src long, dst long"), spark.range(60).withColumnRenamed("id", "node")).collect()}
    want = {0: 0}
    for k in range(1, 60):
        want[k] = 1 + max(want[d] for s, d in down if s == k)
    assert level == want


def test_sessions_over_several_batches(spark, tmp_path):
    rng = random.Random(7)
    start = datetime.datetime(2024, 1, 1)
    times = sorted((start + datetime.timedelta(seconds=rng.randrange(200_000)), rng.randrange(4)) for _ in range(300))
    for i in range(3):
        spark.createDataFrame(times[100 * i : 100 * i + 100], "ts timestamp_ntz, user_id long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/e/part={i}.parquet")
    source = spark.readStream.schema("ts timestamp, user_id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/e")
    got = sorted((r["key"], r["events"]) for r in sessions(source, "user_id", 900).collect())
    want = []
    for user in range(4):
        own, n = [t for t, u in times if u == user], 0
        for a, b in zip([None, *own], own):
            if a is not None and (b - a).total_seconds() > 900:
                want.append((user, n))
                n = 0
            n += 1
        want.append((user, n))
    assert got == sorted(want)


def test_spaced_repetition(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(5), i, rng.choice([None, 0.1, 0.5, 0.65, 0.9, 1.0])) for i in range(120)]
    got = {r["k"]: (round(r["ease"], 9), r["repetitions"], r["interval_days"]) for r in mastery.sm2(spark.createDataFrame(rows, "k int, i int, p double"), ["k"], ["i"], "p").collect()}
    want = {}
    for k, _, p in rows:
        if p is None:
            continue
        ease, reps, days = want.get(k, (2.5, 0, 0))
        q = int(p * 5)
        ease = max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
        reps, days = (0, 1) if q < 3 else (reps + 1, 1 if reps == 0 else 6 if reps == 1 else int(days * ease))
        want[k] = (ease, reps, days)
    assert got == {k: (round(e, 9), r, d) for k, (e, r, d) in want.items()}


def test_csv_keeps_odd_texts(spark):
    rows = [(1, 'a "quoted", text'), (2, "two\nlines"), (3, ""), (4, None), (5, "back\\slash")]
    assert sorted(map(tuple, exports.csv(spark.createDataFrame(rows, "id int, t string")).collect())) == rows


def test_merged_intervals_over_ranges(spark):
    """A key with most intervals, null keys, equal begins, more ranges than keys."""
    rng = random.Random(12)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), b := rng.randrange(3000), b + rng.randrange(6)) for _ in range(600)]
    df = spark.createDataFrame(rows, "book string, begin long, finish long").repartition(5)
    got = sorted((r["book"] or "", r["begin"], r["finish"], r["regions"], r["length"]) for r in intervals.merged(df, "book", 2, {"length": F.sum(F.col("finish") - F.col("begin"))}).collect())
    want = []
    for book in ("hot", "cold", None):
        islands = []
        for _, b, f in sorted((r for r in rows if r[0] == book), key=lambda r: r[1:]):
            if islands and b <= islands[-1][1] + 2:
                a, c, n, size = islands[-1]
                islands[-1] = (a, max(c, f), n + 1, size + f - b)
            else:
                islands.append((b, f, 1, f - b))
        want += [(book or "", *i) for i in islands]
    assert got == sorted(want)
    assert intervals.merged(df.where("begin < 0"), "book", 2).collect() == []


def test_weighted_steps_are_decimals(spark):
    """0.1 * 0.8 is no more than 0.2 * 0.4, and of equal factors the first is the reason; halves of a millionth round as in SQL."""
    import duckdb

    from skeinlake.operators import recommend

    row = {"content": 0.0, "collaborative": 0.4, "prerequisite": 0.0, "difficulty": 0.0, "recency": 0.8, "diversity": 0.35}
    got = spark.createDataFrame([row]).select(recommend.reasons().alias("r"), recommend.weighted("diversity").alias("d")).first()
    assert (got["r"], got["d"]) == ("collaborative", 0.035)
    halves = [(2 * k + 1) / 2_000_000 for k in range(0, 500_000, 173)]
    rounded = [r[0] for r in spark.createDataFrame([(x,) for x in halves], "x double").select(recommend.six(F.col("x"))).collect()]
    assert rounded == [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [halves]).fetchall()]
