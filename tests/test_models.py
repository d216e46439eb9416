"""Upserts, ownership matching, boundary model, rankers and truth on small fixtures."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hindcast.operators import boundary as bd
from hindcast.operators import ownership, truth, upsert
from hindcast.plans import rankers

T0 = datetime(2024, 1, 1)


def test_file_upsert_keeps_heads_apart(spark):
    rows = spark.createDataFrame([(1, "abc", "a.py", 1, 1), (1, "abc", "a.py", 3, 2), (1, "def", "a.py", 2, 3), (1, None, "a.py", 9, 4)],
                                 "pr_id int, head_sha string, path string, changes int, seq int")
    got = upsert.upsert_files(rows, ["pr_id", "head_sha", "path"], ["seq"]).collect()
    assert sorted((r.head_sha, r.changes) for r in got) == [("abc", 3), ("def", 2)]


def test_all_matching_rules_count(spark):
    text = "# owners\n*.py @a @acme/core\nsrc/ @b\nutil.py @c\nnoowner\n"
    texts = spark.createDataFrame([(1, "s", "CODEOWNERS", text)], "repo_id int, base_sha string, path string, text string")
    files = spark.createDataFrame([(7, 1, "s", "src/x/util.py"), (7, 1, "s", "README.md")], "pr_id int, repo_id int, base_sha string, path string")
    hits = ownership.file_owner_hits(files, ownership.ownership_rules(texts))
    assert sorted((r.target_name, r.pattern) for r in hits.collect()) == [("a", "*.py"), ("acme/core", "*.py"), ("b", "src/"), ("c", "util.py")]


def test_cochange_votes_equal_pair_sums(spark):
    sets = spark.createDataFrame([(1, p, f) for p, fs in enumerate([["src/a", "src/b", "t/x"], ["src/a", "t/x", "t/y"], ["src/a"]]) for f in fs],
                                 "repo_id int, pr_id int, path string")
    pairs = bd.cochange_pairs(sets, block=2).withColumn("boundary_id", F.concat(F.lit("dir:"), F.split_part("file_b", F.lit("/"), F.lit(1))))
    want = {(r.file_a, r.boundary_id): round(r.v, 9) for r in pairs.groupBy("file_a", "boundary_id").agg(F.sum("p_b_given_a").alias("v")).collect()}
    got = {(r.path, r.boundary_id): round(r.vote, 9) for r in bd.cochange_votes(sets).collect()}
    assert got == want
    total = bd.memberships(sets).groupBy("path").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-6 for r in total)
    assert bd.violations(bd.memberships(sets), sets.select("repo_id", "path").distinct()).count() == 0


def test_union_scores_and_rerank_fallback(spark):
    schema = f"router_id string, pr_id int, rank int, target_type string, target_name string, score double, evidence {rankers._EVIDENCE}"
    ev = [("k", None, {})]
    routes = spark.createDataFrame([("mentions", 1, 1, "user", "Bob", 1.0, ev), ("popularity", 1, 1, "user", "bob", 0.5, ev), ("popularity", 1, 2, "user", "eve", 0.4, ev)], schema)
    got = rankers.union([routes]).collect()
    assert [(r.rank, r.target_name.lower(), round(r.score, 6)) for r in got] == [(1, "bob", 21.015), (2, "eve", 10.404)]
    hybrid = rankers.hybrid(rankers.union([routes])).collect()
    assert round(hybrid[0].score, 6) == round(10 * (1.0 + 0.8) + 21.015, 6)
    none = spark.createDataFrame([(1, "user", "stranger", 9.0)], "pr_id int, target_type string, target_name string, score double")
    assert [r.target_name.lower() for r in rankers.rerank(rankers.union([routes]), none).collect()] == ["bob", "eve"]


def _truth(spark, reviews, gaps, horizon):
    cohort = spark.createDataFrame([(1, 100, T0, 10)], "repo_id int, pr_id int, cutoff timestamp, author_id int")
    users = spark.createDataFrame([(10, "alice", "User"), (11, "bob", "User"), (12, "robot", "Bot"), (13, "helper[bot]", None)], "user_id int, login string, type string")
    revs = spark.createDataFrame(reviews, "review_id string, pr_id int, user_id int, state string, submitted_at timestamp")
    none = spark.createDataFrame([], "comment_id string, pr_id int, user_id int, review_id string, created_at timestamp")
    hor = spark.createDataFrame([(1, horizon)], "repo_id int, horizon_max timestamp")
    gap = spark.createDataFrame(gaps, "repo_id int, resource string")
    rows = truth.label(cohort, truth.responses(revs, none, users), hor, gap, truth.BUILTIN_POLICIES).collect()
    return {r.policy_id: (r.selected_login, r.status) for r in rows}


def test_truth_window_bots_author_and_status(spark):
    m = lambda n: T0 + timedelta(minutes=n)
    late = m(600)
    got = _truth(spark, [("0", 100, 11, "COMMENTED", T0), ("1", 100, 12, "APPROVED", m(1)), ("2", 100, 13, "APPROVED", m(2)), ("3", 100, 10, "APPROVED", m(3)),
                         ("4", 100, 11, "COMMENTED", m(60))], [], late)
    assert got["first_response_v1"] == ("bob", "observed")
    assert got["first_approval_v1"] == (None, "no_post_cutoff_response")
    assert got["merger_v1"] == (None, "policy_unavailable")
    assert _truth(spark, [("4", 100, 11, "APPROVED", m(61))], [], late)["first_response_v1"] == (None, "no_post_cutoff_response")
    assert _truth(spark, [("4", 100, 11, "APPROVED", m(61))], [(1, "reviews")], late)["first_response_v1"][1] == "unknown_due_to_ingestion_gap"
    assert _truth(spark, [("4", 100, 11, "APPROVED", m(61))], [(1, "tags")], m(30))["first_response_v1"][1] == "unknown_due_to_ingestion_gap"


def test_shares_are_exact_fractions(spark):
    from decimal import ROUND_HALF_UP, Decimal
    from fractions import Fraction

    from hindcast.operators import boundary as bd

    # 20 x 28 + 7 x 80 x ... : file a/x is in 16 pull requests with many other files, so that shares end in a 5 at the ninth digit.
    rows = []
    for prs, others in ((30, 280), (93, 100), (16, 320), (58, 200), (65, 180), (72, 160)):
        for p in range(prs):
            rows.append((prs, p, "a/x"))
            rows += [(prs, p, f"b{j % 3}/{j}") for j in range(others // prs + (p < others % prs))]
    sets = spark.createDataFrame(rows, "repo_id int, pr_id int, path string")
    got = {(r.repo_id, r.boundary_id): r.weight for r in bd.memberships(sets).filter("path = 'a/x'").collect()}
    for repo in {r[0] for r in rows}:
        prs = [p for rp, p, f in rows if rp == repo and f == "a/x"]
        parts = {"dir:a": 20 * len(prs)}
        for rp, _, f in rows:
            if rp == repo and f != "a/x":
                parts["dir:" + f.split("/")[0]] = parts.get("dir:" + f.split("/")[0], 0) + 7
        whole = sum(parts.values())
        for b, part in parts.items():
            exact = Fraction(part, whole)
            digits = (Decimal(exact.numerator) / Decimal(exact.denominator)).quantize(Decimal("1e-8"), ROUND_HALF_UP)
            assert got[repo, b] == float(digits)


def test_growing_models_equal_models_built_anew(spark):
    from hindcast.operators import boundary as bd

    rows = [(r, 3 + p % 4, p, f"{'abc'[(p + j) % 3]}/{(p * j) % 5}") for r in (0, 1) for p in range(20) for j in range(3)]
    rows = [x for x in rows if x[1] != 5]
    born = spark.createDataFrame(rows, "r long, m long, pr_id int, path string").distinct()
    got = bd.growing_memberships(born.selectExpr("r * 100 + m as repo_id", "pr_id", "path"), 8, 100)
    again = born.selectExpr("explode(sequence(m, 8L)) as q", "r", "pr_id", "path").selectExpr("r * 100 + q as repo_id", "pr_id", "path")
    key = lambda df: sorted(tuple(r) for r in df.select("repo_id", "path", "boundary_id", "weight").collect())
    assert key(got) == key(bd.memberships(again)) and {r.repo_id for r in got.collect()} == {r * 100 + q for r in (0, 1) for q in range(3, 9)}
