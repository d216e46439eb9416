"""Validity intervals (slowly changing dimensions) rebuilt from the event log.

An interval is ``[start_ts, end_ts)`` with the ids of the events that opened and
closed it; an open interval has null ends.  Ties on time are broken by event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.ordered import next_where


def build_intervals(
    events: DataFrame,
    keys: list[str],
    opens: Column,
    closes: Column,
    values: dict[str, Column] | None = None,
    ts: str = "occurred_at",
    tie: str = "event_id",
    chunk: str = "DAY",
) -> DataFrame:
    """One interval per opening event; it ends at the next closing event of its key.

    * state family: every event both opens and closes;
    * membership family: ``add`` opens, ``remove`` closes all that are open;
    * comment family: created/edited open, edited/deleted close.
    """
    relevant = events.filter(opens | closes).select(
        *keys, F.col(ts).alias("start_ts"), F.col(tie).alias("start_event_id"),
        opens.alias("_opens"), closes.alias("_closes"),
        *[c.alias(n) for n, c in (values or {}).items()],
    )
    closed = next_where(relevant, keys, "start_ts", "start_event_id", F.col("_closes"), "_end", chunk)
    return closed.filter("_opens").select(
        *keys, *(values or {}), "start_ts", "start_event_id",
        F.col("_end.ts").alias("end_ts"), F.col("_end.id").alias("end_event_id"),
    )


def state_intervals(events: DataFrame, keys: list[str], values: dict[str, Column], **kw) -> DataFrame:
    return build_intervals(events, keys, F.lit(True), F.lit(True), values, **kw)


def membership_intervals(
    events: DataFrame, keys: list[str], adds: Column, removes: Column, values: dict[str, Column] | None = None, **kw
) -> DataFrame:
    return build_intervals(events, keys, adds, removes, values, **kw)


def issue_state(events: DataFrame) -> DataFrame:
    opened = F.col("event_type").isin("issue.opened", "issue.reopened")
    closed = F.col("event_type") == "issue.closed"
    log = events.filter(opened | closed).withColumnRenamed("subject_id", "issue_id")
    return state_intervals(log, ["issue_id"], {"state": F.when(opened, "open").otherwise("closed")})


def issue_content(events: DataFrame) -> DataFrame:
    log = events.filter(F.col("event_type").isin("issue.content.set", "issue.content.edit"))
    return state_intervals(
        log.withColumnRenamed("subject_id", "issue_id"), ["issue_id"],
        {"title": F.col("p_title"), "body": F.col("p_body")},
    )


def issue_membership(events: DataFrame, add: str, remove: str, object_name: str) -> DataFrame:
    """Labels, assignees and milestones: keyed by issue and object."""
    log = events.filter(F.col("event_type").isin(add, remove)).select(
        F.col("subject_id").alias("issue_id"), F.col("object_id").alias(object_name),
        "event_type", "occurred_at", "event_id",
    )
    return membership_intervals(
        log, ["issue_id", object_name], F.col("event_type") == add, F.col("event_type") == remove
    )


def review_requests(events: DataFrame) -> DataFrame:
    """A removal ends every open request of the reviewer id, whatever its type."""
    return membership_intervals(
        events, ["pr_id", "reviewer_id"], F.col("op") == "add", F.col("op") == "remove",
        {"reviewer_type": F.col("reviewer_type")},
    )


def comment_content(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    log = events.withColumnRenamed("subject_id", "comment_id")
    return build_intervals(
        log, ["comment_id"],
        kind.isin("comment.created", "comment.edited"), kind.isin("comment.edited", "comment.deleted"),
        {"body": F.col("p_body")},
    )


def review_content(events: DataFrame) -> DataFrame:
    log = events.filter(F.col("event_type").isin("review.submitted", "review.edited"))
    return state_intervals(
        log.withColumnRenamed("subject_id", "review_id"), ["review_id"],
        {"body": F.col("p_body"), "state": F.col("p_state")},
    )


def heads(head_events: DataFrame) -> DataFrame:
    return state_intervals(head_events, ["pr_id"], {"head_sha": F.col("head_sha")})


def drafts(draft_events: DataFrame) -> DataFrame:
    return state_intervals(draft_events, ["pr_id"], {"is_draft": F.col("is_draft")})
