"""Windowed operators against brute force on small random data."""

import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hindcast.operators import activity as act
from hindcast.operators.toplist import windowed_top

BASE = datetime(2024, 1, 1)


def _rows(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(2), f"u{rng.randrange(8)}", BASE + timedelta(minutes=rng.randrange(60 * 24 * 60)), 1) for _ in range(n)]


def test_windowed_top_is_exact(spark):
    rows = _rows(600, 3)
    rng = random.Random(5)
    cuts = [(rng.randrange(2), BASE + timedelta(minutes=rng.randrange(60 * 24 * 70))) for _ in range(40)] + [(0, rows[0][2])]
    acts = spark.createDataFrame(rows, "g int, m string, ts timestamp, value long")
    asked = spark.createDataFrame(sorted(set(cuts)), "g int, cutoff timestamp")
    got = windowed_top(asked, acts, ["g"], "m", 3, 20 * 86400, 21600)
    by_cut = {}
    for r in got.collect():
        by_cut.setdefault((r.g, r.cutoff), []).append((-r.total, r.m))
    for g, c in set(cuts):
        counts = Counter(m for gg, m, t, _ in rows if gg == g and c - timedelta(days=20) <= t <= c)
        want = sorted((-n, m) for m, n in counts.items())[:3]
        assert sorted(by_cut.get((g, c), [])) == want


def test_trailing_counts_and_open_spans(spark):
    rows = _rows(200, 9)
    asks = [(g, BASE + timedelta(days=d)) for g in (0, 1) for d in (5, 30, 59)]
    df = spark.createDataFrame(rows, "g int, m string, ts timestamp, value long")
    asked = spark.createDataFrame(asks, "g int, cutoff timestamp")
    got = {(r.g, r.cutoff): (r.n_7d, r.n_30d) for r in act.trailing_counts(asked, df, ["g"], [7, 30], {"n": F.lit(1)}).collect()}
    for g, c in asks:
        n = lambda d: sum(1 for gg, _, t, _ in rows if gg == g and c - timedelta(days=d) <= t <= c)
        assert got[(g, c)] == (n(7), n(30))
    spans = [(g, t, t + timedelta(days=4)) for g, _, t, _ in rows[:60]]
    opened = act.open_at(asked, spark.createDataFrame(spans, "g int, a timestamp, b timestamp"), ["g"], "a", "b", "n")
    assert {(r.g, r.cutoff): r.n for r in opened.collect()} == {(g, c): sum(1 for gg, a, b in spans if gg == g and a <= c < b) for g, c in asks}


def test_most_recent_rows(spark):
    rows = _rows(150, 21)
    df = spark.createDataFrame(rows, "g int, m string, ts timestamp, value long")
    cohort = spark.createDataFrame([(1, 0, BASE + timedelta(days=40)), (2, 1, BASE + timedelta(days=25))], "pr int, g int, cutoff timestamp")
    got = act.most_recent(cohort, df, "g", 30, 10, "ts", ["m"])
    for pr, g, c in [(1, 0, BASE + timedelta(days=40)), (2, 1, BASE + timedelta(days=25))]:
        want = sorted([(t, m) for gg, m, t, _ in rows if gg == g and c - timedelta(days=30) <= t <= c], key=lambda x: (-x[0].timestamp(), x[1]))[:10]
        assert sorted((r.ts, r.m) for r in got.filter(F.col("pr") == pr).collect()) == sorted(want)


def test_windowed_top_drops_members_that_cannot_reach_the_top(spark):
    from hindcast.operators import toplist

    rng = random.Random(8)
    strong = [(0, f"s{i}", BASE + timedelta(minutes=30 * j + i), 1) for i in range(4) for j in range(0, 48 * 60, 3)]
    weak = [(0, f"w{i:03}", BASE + timedelta(minutes=rng.randrange(60 * 24 * 60)), 1) for i in range(200) for _ in range(3)]
    rows = strong + weak
    cuts = [BASE + timedelta(minutes=rng.randrange(60 * 24 * 30, 60 * 24 * 60)) for _ in range(30)]
    acts = spark.createDataFrame(rows, "g int, m string, ts timestamp, value long")
    asked = spark.createDataFrame([(0, c) for c in cuts], "g int, cutoff timestamp")
    hour = F.floor(F.unix_seconds("ts") / 3600).cast("bigint")
    cut = acts.filter(F.col("ts") >= F.lit(BASE + timedelta(days=22))).select("g", "m", F.col("ts").alias("_ts"), F.col("value").alias("_v"), hour.alias("_b"))
    left = toplist._contending(cut.withColumn("_p", F.floor(F.col("_b") / 48).cast("bigint")), ["g"], "m", 3, 10, True)
    first = min(r._p for r in left.select("_p").distinct().collect())
    assert {r.m for r in left.filter(F.col("_p").between(first + 12, first + 15)).select("m").distinct().collect()} <= {f"s{i}" for i in range(4)}
    got = {(r.cutoff, r.m): r.total for r in windowed_top(asked, acts, ["g"], "m", 3, 20 * 86400).collect()}
    for c in cuts:
        counts = Counter(m for _, m, t, _ in rows if c - timedelta(days=20) <= t <= c)
        want = sorted((-n, m) for m, n in counts.items())[:3]
        assert [(m, got[c, m]) for _, m in want] == [(m, -n) for n, m in want] and sum(k[0] == c for k in got) == len(want)
