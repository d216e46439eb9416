"""Shared files of stewards: an act counts once, however many files it shares."""

from pyspark.sql import functions as F

from hindcast.plans import rankers


def test_an_act_counts_once_for_all_shared_paths(spark):
    ts = lambda d: F.expr(f"timestamp_ntz '2020-01-31 00:00:00' - ({d}) * interval '1' day")
    cohort = spark.createDataFrame([(1, 10, "ann"), (1, 11, None)], "repo_id long, pr_id long, author_login string").withColumn("cutoff", ts("0"))
    acts = spark.createDataFrame(
        [(1, "bob", "User", 0, "review_submitted", [1, 2, 3]), (1, "bob", "User", 30, "review_submitted", [2, 9]), (1, "cy", "User", 30, "comment_created", [7]),
         (1, "ann", "User", 0, "review_submitted", [1, 2]), (1, "old", "User", 200, "review_submitted", [1])],
        "repo_id long, login string, type string, d long, kind string, paths array<long>").withColumn("ts", ts("d"))
    held = cohort.select("repo_id", "pr_id", "cutoff").withColumn("paths", F.expr("case pr_id when 10 then array(3L, 2L, 1L) else array(7L) end"))
    got = {(r.pr_id, r.target_name): (round(r.score, 9), r.rank) for r in rankers.stewards(cohort, acts.drop("paths"), acts, held, 5).collect()}
    bob = 0.2 * (1 + 0.5)
    assert got == {(10, "bob"): (round(1.5 + bob, 9), 1), (10, "cy"): (round(0.2 * 0.1, 9), 2),
                   (11, "bob"): (round(bob, 9), 1), (11, "ann"): (0.2, 2), (11, "cy"): (round(0.1 + 0.2 * 0.1, 9), 3)}
