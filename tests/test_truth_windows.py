"""Only responses inside a cohort's windows meet the users, with the same labels."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hindcast.operators import truth

BASE = datetime(2024, 1, 1)


def _tables(spark):
    cohort = spark.createDataFrame([(1, pr, BASE + timedelta(days=pr), 7) for pr in range(4)], "repo_id int, pr_id int, cutoff timestamp, author_id int")
    rows = [(pr, u, BASE + timedelta(days=pr, minutes=m), f"r{pr}-{u}-{m}", "APPROVED") for pr in range(4) for u, m in ((7, 5), (8, -30), (9, 20), (10, 60), (8, 61), (9, 9000))]
    reviews = spark.createDataFrame(rows, "pr_id int, user_id int, submitted_at timestamp, review_id string, state string")
    none = reviews.filter("false").select("pr_id", "user_id", F.col("submitted_at").alias("created_at"), F.col("review_id"), F.lit("").alias("comment_id"))
    users = spark.createDataFrame([(7, "ann", "User"), (8, "bob", "User"), (9, "ci", "Bot"), (10, "eve", None), (11, None, "User")], "user_id int, login string, type string")
    horizons = spark.createDataFrame([(1, BASE + timedelta(days=90))], "repo_id int, horizon_max timestamp")
    gaps = spark.createDataFrame([(2, "reviews")], "repo_id int, resource string")
    return cohort, reviews, none, users, horizons, gaps


def test_labels_name_users_inside_the_window_only(spark):
    cohort, reviews, none, users, horizons, gaps = _tables(spark)
    early = truth.label(cohort, truth.responses(reviews, none, users), horizons, gaps, truth.BUILTIN_POLICIES)
    late = truth.label(cohort, truth.responses(reviews, none), horizons, gaps, truth.BUILTIN_POLICIES, users=users)
    assert sorted(map(str, early.collect())) == sorted(map(str, late.collect()))
    assert {r.selected_login for r in late.filter("policy_id = 'first_response_v1'").collect()} == {"eve"}


def test_near_keeps_what_some_cutoff_may_use(spark):
    cohort, reviews, none, users, _, _ = _tables(spark)
    again = cohort.unionByName(cohort.filter("pr_id = 1").withColumn("cutoff", F.expr("cutoff + interval '6' day")))
    kept = truth.near(truth.responses(reviews, none), again, 3600)
    got = sorted((r.pr_id, r.ts) for r in kept.collect())
    want = sorted((r.pr_id, r.submitted_at) for r in reviews.collect() if BASE + timedelta(days=r.pr_id) < r.submitted_at
                  <= BASE + timedelta(days=7 if r.pr_id == 1 else r.pr_id, hours=1))
    assert got == want
    assert "login" not in kept.columns and {r.login for r in truth.named(kept, users).collect()} <= {"ann", "bob", "ci", "eve"}
