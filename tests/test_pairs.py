"""Features of candidates against plain Python, and that pairs do not meet tables of their own size."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from statistics import median

from pyspark.sql import functions as F

from hindcast.operators import activity as act
from hindcast.plans import features as ft

BASE = datetime(2024, 1, 1)
DAY = timedelta(days=1)


def _joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_trailing_counts_look_nothing_up_afterwards(spark):
    """a probe keeps its asked time; only the totals of chunks are joined."""
    rows = spark.createDataFrame([(1, BASE), (1, BASE + DAY), (2, BASE)], "g int, ts timestamp_ntz")
    asked = spark.createDataFrame([(1, BASE + 7 * DAY), (1, BASE + 7 * DAY), (1, BASE + 8 * DAY), (3, BASE)], "g int, cutoff timestamp_ntz")
    counts = act.trailing_counts(asked, rows, ["g"], [6, 7], {"n": F.lit(1)})
    assert sorted((r.g, (r.cutoff - BASE).days, r.n_6d, r.n_7d) for r in counts.collect()) == [(1, 7, 1, 2), (1, 8, 0, 1), (3, 0, 0, 0)]
    assert _joins(counts) == 1


def test_candidate_activity_is_one_ordered_pass(spark):
    """the pairs pass among the moves and are joined with totals of chunks only."""
    rng = random.Random(5)
    t = lambda days: BASE + timedelta(hours=rng.randrange(24 * days))
    acts = [(r, u, t(400), k) for r in (0, 1) for u in (1, 2, 3) for k in ("review_submitted", "comment_created") for _ in range(25)]
    wrote = [(r, u, t(400)) for r in (0, 1) for u in (1, 4) for _ in range(4)]
    spans = [(rng.randrange(2), rng.randrange(1, 4), i, a, a + timedelta(hours=rng.randrange(1, 900)) if i % 3 else None) for i in range(30) for a in [t(300)]]
    pairs = [(r, 10 * i + r, c, login, u, "Bot" if u == 3 else "User" if u else None) for i in range(40) for r in (0, 1)
             for c in [acts[i][2] + DAY * rng.choice([0, 7, 30, 90, 180]) if i % 2 else t(500)] for login, u in (("a", 1), ("b", 2), ("c", 3), ("d", 4), ("nobody", None), ("x[bot]", None))]
    found = ft.candidate_activity(
        spark.createDataFrame(pairs, "repo_id long, pr_id long, cutoff timestamp_ntz, login string, user_id long, type string"),
        spark.createDataFrame(acts, "repo_id long, user_id long, ts timestamp_ntz, kind string"),
        spark.createDataFrame(wrote, "repo_id long, user_id long, ts timestamp_ntz"),
        spark.createDataFrame(spans, "repo_id long, user_id long, pr_id long, start_ts timestamp_ntz, end_ts timestamp_ntz"))
    assert _joins(found) == 1
    got = {(r.pr_id, r.login): r for r in found.collect()}
    assert len(got) == len(pairs)
    for repo, pr, c, login, u, kind in pairs:
        r = got[pr, login]
        own = [(ts, k) for rr, uu, ts, k in acts if (rr, uu) == (repo, u) and ts <= c]
        mine = [ts for rr, uu, ts in wrote if (rr, uu) == (repo, u) and ts <= c]
        for d in ft.WINDOWS:
            assert r[f"events_{d}d"] == sum(ts >= c - d * DAY for ts, _ in own)
        assert r.reviews_180d == sum(ts >= c - 180 * DAY and k == "review_submitted" for ts, k in own)
        assert r.comments_180d == sum(ts >= c - 180 * DAY and k != "review_submitted" for ts, k in own)
        assert r.authored_180d == sum(ts >= c - 180 * DAY for ts in mine)
        assert r.last_seen_seconds == ((c - max(ts for ts, _ in own)).total_seconds() if own else None)
        born = [ts for ts, _ in own] + mine
        assert r.account_age_days == ((c - min(born)).total_seconds() / 86400.0 if born else None)
        assert r.open_reviews == sum((rr, uu) == (repo, u) and a <= c and (b is None or c < b) for rr, uu, _, a, b in spans)
        assert r.is_bot == (kind == "Bot" or login.endswith("[bot]"))


def test_pair_social_rides_on_the_pull_request(spark):
    """what authors and users had to do with each other is a list on the row of the pull request; pairs meet no table."""
    rng = random.Random(8)
    t = lambda days: BASE + timedelta(hours=rng.randrange(24 * days))
    prs = [(i, i % 2, rng.choice([1, 2, None]), t(500)) for i in range(40)]
    acts = [(p[1], rng.choice([5, 6, 7, 8]), p[0], p[3] + timedelta(hours=rng.randrange(-50, 4000)), rng.choice(["review_submitted", "comment_created"])) for p in prs for _ in range(5)]
    users = [(5, "Ann"), (6, "bob"), (7, "ANN"), (8, None)]
    cohort = [(p[0], p[1], p[2], p[3] + 3 * DAY) for p in prs]
    asks = spark.createDataFrame(cohort, "pr_id long, repo_id long, author_id long, cutoff timestamp_ntz")
    facts = ft.social_facts(asks, spark.createDataFrame(acts, "repo_id long, user_id long, pr_id long, ts timestamp_ntz, kind string"),
                            spark.createDataFrame(prs, "pr_id long, repo_id long, author_id long, created_at timestamp_ntz"), spark.createDataFrame(users, "user_id long, login string"))
    rows = asks.join(facts, ["repo_id", "author_id", "cutoff"], "left").localCheckpoint()
    pool = rows.select("*", F.explode(F.array(*[F.lit(x) for x in ("ann", "bob", "eve")])).alias("login"))
    found = ft.pair_social(pool)
    assert _joins(found) == 0
    got = {(r.pr_id, r.login): r for r in found.collect()}
    assert len(got) == 3 * len(prs) and any(r.latency_median for r in got.values())
    for pr, repo, author, c in cohort:
        for login, user in (("ann", 5), ("bob", 6), ("eve", None)):
            near = {q[0]: q[3] for q in prs if author and q[2] == author and c - 180 * DAY <= q[3] <= c}
            own = [(q, ts, k) for r, u, q, ts, k in acts if u == user and r == repo and q in near and ts <= c]
            waits = [max((min(ts for q, ts, _ in own if q == n) - near[n]).total_seconds(), 0) for n in {q for q, _, _ in own}]
            r = got[pr, login]
            reviews = sum(k == "review_submitted" for _, _, k in own)
            assert (r.prior_interactions, r.prior_reviews, r.prior_comments) == (len(own), reviews, len(own) - reviews)
            assert r.latency_median == (median(waits) if waits else None)
