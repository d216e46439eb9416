"""Intervals against a sequential replay, and order independence."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hindcast.operators import asof, intervals


def _events(n, seed):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)
    return [(rng.randrange(4), rng.randrange(3), rng.choice(["add", "remove"]), base + timedelta(hours=rng.randrange(200)), i) for i in range(n)]


def _replay(rows):
    out = []
    for subject, obj, op, _ts, eid in sorted(rows, key=lambda r: (r[3], r[4])):
        if op == "add":
            out.append([subject, obj, eid, None])
        else:
            for iv in out:
                if iv[0] == subject and iv[1] == obj and iv[3] is None:
                    iv[3] = eid
    return sorted(map(tuple, out), key=lambda r: r[2])


def test_membership_equals_replay(spark):
    rows = _events(300, 7)
    df = spark.createDataFrame(rows, "s int, o int, op string, occurred_at timestamp, event_id int")
    got = intervals.membership_intervals(df, ["s", "o"], F.col("op") == "add", F.col("op") == "remove")
    assert sorted(map(tuple, got.select("s", "o", "start_event_id", "end_event_id").collect()), key=lambda r: r[2]) == _replay(rows)


def test_state_intervals_never_overlap_and_ignore_input_order(spark):
    rows = _events(200, 11)
    a = spark.createDataFrame(rows, "s int, o int, op string, occurred_at timestamp, event_id int")
    b = spark.createDataFrame(list(reversed(rows)), a.schema)
    build = lambda df: sorted(map(tuple, intervals.state_intervals(df, ["s"], {"op": F.col("op")}).select(
        "s", "op", "start_event_id", "end_event_id").collect()), key=str)
    assert build(a) == build(b)
    open_ends = [r for r in build(a) if r[3] is None]
    assert len(open_ends) == len({r[0] for r in rows})


def test_half_open_validity_and_no_leakage(spark):
    day = lambda d: datetime(2024, 1, d)
    heads = spark.createDataFrame([(1, "a", day(1), "e1"), (1, "b", day(3), "e2")], "pr_id int, head_sha string, occurred_at timestamp, event_id string")
    cohort = spark.createDataFrame([(1, day(3)), (1, day(2))], "pr_id int, cutoff timestamp")
    at = lambda h: {r.cutoff: r.head_sha for r in asof.state_at(cohort, intervals.heads(h), ["pr_id"], ["head_sha"], ["pr_id", "cutoff"]).collect()}
    assert at(heads) == {day(3): "b", day(2): "a"}
    future = heads.unionByName(spark.createDataFrame([(1, "c", day(9), "e3")], heads.schema))
    assert at(future) == at(heads)
