"""A snapshot joins its authors before its texts."""

from __future__ import annotations

from hindcast.operators import asof


def test_no_text_moves_to_the_authors(spark):
    cohort = spark.createDataFrame([(1, "2024-01-03"), (2, "2024-01-03")], "pr_id long, cutoff string").selectExpr("pr_id", "cast(cutoff as timestamp) as cutoff")
    prs = spark.createDataFrame([(1, 11, 7, "b"), (2, 12, 8, "b")], "pr_id long, issue_id long, author_id long, base_sha string")
    content = spark.createDataFrame([(11, "t", "old", "2024-01-01", "a"), (11, "t2", "new", "2024-01-02", "b")], "issue_id long, title string, body string, s string, start_event_id string").selectExpr(
        "issue_id", "title", "body", "cast(s as timestamp) as start_ts", "start_event_id", "case when body = 'old' then timestamp '2024-01-02' end as end_ts")
    heads = spark.createDataFrame([(1, "h", "2024-01-01", "x")], "pr_id long, head_sha string, s string, start_event_id string").selectExpr(
        "pr_id", "head_sha", "cast(s as timestamp) as start_ts", "start_event_id", "cast(null as timestamp) as end_ts")
    users = spark.createDataFrame([(7, "ann")], "user_id long, login string")
    snaps = asof.snapshot(cohort, prs, content, heads, users)
    rows = {r.pr_id: (r.as_of_title, r.as_of_body, r.author_login, r.head_sha, r.missing_content) for r in snaps.collect()}
    assert rows == {1: ("t2", "new", "ann", "h", False), 2: (None, None, None, None, True)}
    lines = snaps._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "Join" in line and "(author_id" in line)
    below = []
    for line in lines[at + 1:]:
        if depth(line) <= depth(lines[at]):
            break
        below.append(line)
    assert below and not any("body" in line for line in below)
