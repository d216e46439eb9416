"""State of pull requests as of a cutoff, without looking past it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.ordered import last_value_before


def valid_at(at: Column, start: str = "start_ts", end: str = "end_ts") -> Column:
    """Half-open validity: started at or before ``at`` and not yet ended."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end)))


def active_at(cohort: DataFrame, intervals: DataFrame, on: list[str], at: str = "cutoff") -> DataFrame:
    """All intervals valid at each cohort row's cutoff (an equi-join per key)."""
    return cohort.join(intervals, on).filter(valid_at(F.col(at)))


def state_at(
    cohort: DataFrame, intervals: DataFrame, on: list[str], values: list[str], ids: list[str], at: str = "cutoff"
) -> DataFrame:
    """The one state valid at the cutoff: latest by (start, event id), one row per cohort row."""
    best = F.max_by(F.struct(*values, "start_ts"), F.struct("start_ts", "start_event_id")).alias("s")
    return active_at(cohort, intervals, on, at).groupBy(*ids).agg(best).select(*ids, "s.*")


def latest_started(
    cohort: DataFrame, intervals: DataFrame, on: list[str], values: list[str], ids: list[str], at: str = "cutoff"
) -> DataFrame:
    """Latest interval started at or before the cutoff, ended or not."""
    best = F.max_by(F.struct(*values), F.struct("start_ts", "start_event_id")).alias("s")
    return (
        cohort.join(intervals, on).filter(F.col("start_ts") <= F.col(at)).groupBy(*ids).agg(best).select(*ids, "s.*")
    )


def attach_as_of(
    events: DataFrame, states: DataFrame, key: str, event_ts: str, state_ts: str, state_tie: str, value: str, out: str
) -> DataFrame:
    """For every event the state of its key at the event's own time.

    States and events are merged into one ordered stream per key, so the cost is
    linear even for a key with very many of both.
    """
    columns = events.columns
    log = states.select(
        F.col(key), F.col(state_ts).alias("_ts"), F.struct(F.lit(0).alias("k"), F.col(state_tie).cast("string").alias("t")).alias("_tie"),
        F.col(value).alias("_v"), F.lit(None).cast(events.select(F.struct(*columns)).schema[0].dataType).alias("_row"),
    )
    asked = events.select(
        F.col(key), F.col(event_ts).alias("_ts"), F.struct(F.lit(1).alias("k"), F.lit("").alias("t")).alias("_tie"),
        F.lit(None).cast(states.schema[value].dataType).alias("_v"), F.struct(*columns).alias("_row"),
    )
    merged = last_value_before(log.unionByName(asked), [key], "_ts", "_tie", F.col("_v"), out)
    return merged.filter(F.col("_row").isNotNull()).select("_row.*", out)


def merged_as_of(cohort: DataFrame, merges: DataFrame) -> DataFrame:
    """Flag per cohort row: a merge event at or before the cutoff exists."""
    hits = (
        cohort.join(merges.select("pr_id", "merged_at"), "pr_id")
        .filter(F.col("merged_at") <= F.col("cutoff"))
        .select("pr_id", "cutoff").distinct().withColumn("merged", F.lit(True))
    )
    return cohort.join(hits, ["pr_id", "cutoff"], "left").withColumn("merged", F.coalesce("merged", F.lit(False)))


def request_targets(requests: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """Resolve reviewer ids: team slugs for teams, logins for users; bots and unknown ids drop out.

    The reviewer type is compared without case, whoever wrote it.
    """
    is_team = F.lower("reviewer_type") == "team"
    team = (
        requests.filter(is_team)
        .join(teams.select(F.col("team_id").alias("reviewer_id"), "slug"), "reviewer_id")
        .filter(F.col("slug").isNotNull())
        .withColumn("target_type", F.lit("team")).withColumnRenamed("slug", "target_name")
    )
    user = (
        requests.filter(~is_team)
        .join(users.select(F.col("user_id").alias("reviewer_id"), "login", "type"), "reviewer_id")
        .filter(F.col("login").isNotNull() & (F.col("type").isNull() | (F.col("type") != "Bot")))
        .drop("type").withColumn("target_type", F.lit("user")).withColumnRenamed("login", "target_name")
    )
    return user.unionByName(team)


def snapshot(cohort: DataFrame, prs: DataFrame, content: DataFrame, heads: DataFrame, users: DataFrame) -> DataFrame:
    """One row per cohort PR: content and head as of the cutoff, base and author.

    Content comes from the issue when the PR has one, else from the PR itself.
    ``missing_content`` and ``missing_head`` mark rows a strict run must refuse.
    """
    ids = ["pr_id", "cutoff"]
    base = cohort.select("pr_id", "cutoff").join(prs, "pr_id")
    text = state_at(
        base.select("pr_id", "cutoff", "issue_id"), content, ["issue_id"], ["title", "body"], ids
    ).select(*ids, F.col("title").alias("c_title"), F.col("body").alias("c_body"), F.lit(True).alias("has_content"))
    head = state_at(cohort.select("pr_id", "cutoff"), heads, ["pr_id"], ["head_sha"], ids).select(*ids, "head_sha")
    names = users.select(F.col("user_id").alias("author_id"), F.col("login").alias("author_login"))
    has_pr_text = {"title", "body"} <= set(prs.columns)
    own = [F.col(c) if has_pr_text else F.lit(None).cast("string") for c in ("title", "body")]
    linked = F.col("issue_id").isNotNull()
    return (
        # Names first: what moves to the authors holds no text.
        base.join(names, "author_id", "left").join(text, ids, "left").join(head, ids, "left")
        .withColumn("as_of_title", F.when(linked, F.col("c_title")).otherwise(own[0]))
        .withColumn("as_of_body", F.when(linked, F.col("c_body")).otherwise(own[1]))
        .withColumn("missing_content", linked & F.col("has_content").isNull())
        .withColumn("missing_head", F.col("head_sha").isNull())
        .drop("c_title", "c_body", "has_content")
    )


def require_complete(snapshots: DataFrame) -> DataFrame:
    """Strict mode: the job fails on the first row without a content or head interval."""
    ok = ~(F.col("missing_content") | F.col("missing_head"))
    guard = F.when(ok, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no interval as of the cutoff for pr "), F.col("pr_id").cast("string"))).cast("boolean"))
    return snapshots.filter(guard)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def within_days(asks: DataFrame, rows: DataFrame, keys: list[str], at: str, ts: str, days: int) -> DataFrame:
    """Join on ``keys`` the rows whose ``ts`` lies in the ``days`` up to and including ``at``.

    Time is cut into blocks of that length: a row is in one block, an asked time looks
    at its own and the one before.  At most about twice the wanted rows meet, however long the
    history of a key is.  Columns other than the keys must have different names.
    """
    block = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(days * 86_400_000_000))
    own = asks.withColumn("_blk", F.explode(F.array(block(at), block(at) - 1)))
    met = own.join(rows.withColumn("_blk", block(ts)), [*keys, "_blk"]).drop("_blk")
    return met.filter((F.col(ts) <= F.col(at)) & (F.col(ts) >= F.col(at) - F.expr(f"interval '{days}' day")))
