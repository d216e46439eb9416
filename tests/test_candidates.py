"""Recent acts as lists and the candidate pool against plain Python, and that neither moves its answer."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hindcast.operators import activity as act
from hindcast.plans import features as ft

BASE = datetime(2024, 1, 1)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_recent_lists_across_blocks(spark):
    rng = random.Random(3)
    rows = [(g, f"m{rng.randrange(6)}", BASE + timedelta(hours=rng.randrange(24 * 50)), rng.randrange(99)) for g in (0, 1) for _ in range(170)]
    df = spark.createDataFrame(rows, "g int, m string, ts timestamp, v long")
    asks = [(i, i % 3, BASE + timedelta(hours=rng.randrange(24 * 90))) for i in range(120)]
    cohort = spark.createDataFrame(asks, "pr int, g int, cutoff timestamp")
    lists = act.recent_lists(cohort, df, "g", 20, 7, "ts", ["m"], values=["v"])
    assert "Window" not in _plan(lists).split("Join")[0] and "Aggregate" not in _plan(lists).split("Join")[0]
    got = {r.pr: [(x.ts, x.m) for x in r.recent] for r in lists.collect()}
    for pr, g, c in asks:
        seen = sorted([(t, m) for gg, m, t, _ in rows if gg == g and c - timedelta(days=20) <= t <= c], key=lambda x: (-x[0].timestamp(), x[1]))[:7]
        assert sorted(got.get(pr, [])) == sorted(seen)
    held = {(g, m, t, v) for g, m, t, v in rows}
    group = {pr: g for pr, g, _ in asks}
    assert all((group[r.pr], x.m, x.ts, x.v) in held for r in lists.collect() for x in r.recent)


def test_candidate_pool_names_everybody_once_and_moves_no_pair(spark):
    cohort = spark.createDataFrame([(1, "ann"), (2, "m1"), (3, None), (4, "x")], "pr_id long, author_login string")
    asked = [(1, "user", "bob"), (1, "team", "acme/core"), (1, "team", "web"), (2, "team", "web"), (3, "user", "m2"), (3, "team", "team:core")]
    requests = spark.createDataFrame(asked, "pr_id long, target_type string, target_name string")
    owners = spark.createDataFrame([(1, "user", "m2"), (1, "user", "bob"), (2, "user", "ann")], requests.schema)
    mentions = spark.createDataFrame([(1, "ann"), (1, "m3"), (3, "eve")], "pr_id long, login string")
    roster = spark.createDataFrame([("core", "m1"), ("Team:core", "m1"), ("core", "m2"), ("team:web", "m1"), ("web", "m3"), ("other", "m4")], "team_key string, member string")
    named = ft.named_candidates(requests, mentions, owners, cohort)
    keys = {r.member: r["keys"] for r in ft.rostered(roster).collect()}
    recent = {1: ["m1", "zoe", "zoe", "bob"], 2: ["m1", "m4", "m3"], 4: ["x", "y"]}
    lists = spark.createDataFrame([(pr, [(m, keys.get(m)) for m in ms]) for pr, ms in recent.items()], "pr_id long, recent array<struct<login: string, keys: array<string>>>")
    pool = ft.candidate_pool(named, named.join(lists, "pr_id"), roster, ["pr_id"])
    assert sorted((r.pr_id, r.login) for r in pool.collect()) == sorted([
        *[(1, n) for n in ("bob", "m1", "m2", "m3", "zoe")], *[(2, n) for n in ("ann", "m3", "m4")], *[(3, n) for n in ("m2", "eve", "m1")], (4, "y")])
    assert not any(node in _plan(pool).split("Join")[0] for node in ("Aggregate", "Distinct", "Window"))
    assert pool.groupBy("pr_id", "login").count().filter(F.col("count") > 1).count() == 0
