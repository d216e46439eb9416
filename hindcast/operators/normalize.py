"""Normalisation of landed API objects into typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD_SCHEMA = """
    event string, created_at string, actor struct<id: bigint>,
    label struct<id: bigint>, assignee struct<id: bigint>, milestone struct<id: bigint>,
    requested_reviewer struct<id: bigint>, requested_team struct<id: bigint>,
    title string, body string, issue struct<title: string, body: string>,
    rename struct<to: string>, comment struct<id: bigint, body: string>,
    comment_id bigint, commit_id string, source struct<issue: struct<id: bigint>>,
    dismissed_review struct<review_id: bigint, id: bigint>, review_id bigint
"""

EVENT_COLUMNS = [
    "repo_id", "occurred_at", "actor_id", "subject_type", "subject_id", "event_type",
    "object_type", "object_id", "commit_sha", "p_title", "p_body", "p_is_draft", "p_head_ref", "p_state", "raw_payload",
]

# Timeline names, the event they become and where the object id sits.
ISSUE_OBJECT_EVENTS = {
    "labeled": ("issue.label.add", "label", "label.id", True),
    "unlabeled": ("issue.label.remove", "label", "label.id", True),
    "assigned": ("issue.assignee.add", "user", "assignee.id", False),
    "unassigned": ("issue.assignee.remove", "user", "assignee.id", False),
    "milestoned": ("issue.milestone.set", "milestone", "milestone.id", True),
    "demilestoned": ("issue.milestone.clear", "milestone", "milestone.id", True),
}
ISSUE_PLAIN_EVENTS = ["closed", "reopened", "opened"]
ISSUE_RAW_EVENTS = [
    "locked", "unlocked", "pinned", "unpinned", "subscribed", "unsubscribed", "mentioned",
    "transferred", "added_to_project", "removed_from_project",
]
REFERENCE_EVENTS = ["referenced", "cross-referenced"]
REQUEST_EVENTS = {
    "review_requested": "pull_request.review_request.add",
    "review_request_removed": "pull_request.review_request.remove",
}
DRAFT_EVENTS = {"ready_for_review": False, "converted_to_draft": True}
COMMIT_EVENTS = {"synchronize": "pull_request.head.set", "merged": "pull_request.merged"}
PULL_RAW_EVENTS = ["head_ref_deleted", "head_ref_restored", "head_ref_force_pushed", "base_ref_force_pushed"]


def _chain(arms: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = F.when(*arms[0])
    for cond, value in arms[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def _truthy(c: Column) -> Column:
    return F.when(c != 0, c)


def normalize_timeline(payloads: DataFrame) -> DataFrame:
    """Typed events from timeline objects (event_id, repo_id, issue_id, pull_request_id, payload).

    One pass over the rows: every output column is a choice among the payload's
    fields; names this engine does not know are kept under
    ``<subject>.event.<name>``.  Both steps go through ``inline``, so the JSON is
    parsed once per row and later filters test finished columns instead of
    repeating the whole choice.
    """
    rows = payloads.select(
        "event_id", "repo_id", "issue_id", "pull_request_id", "payload",
        F.explode(F.array(F.from_json("payload", PAYLOAD_SCHEMA))).alias("p"),
    ).filter(F.col("p.event").isNotNull() & (F.col("p.event") != ""))
    name = F.col("p.event")
    has_pr = F.col("pull_request_id").isNotNull() & (F.col("pull_request_id") != 0)
    null_s, null_l, null_b = (F.lit(None).cast(t) for t in ("string", "bigint", "boolean"))

    objects = list(ISSUE_OBJECT_EVENTS)
    is_request = name.isin(*REQUEST_EVENTS) & has_pr
    is_draft = name.isin(*DRAFT_EVENTS) & has_pr
    is_commit = name.isin(*COMMIT_EVENTS) & has_pr
    is_dismissed = (name == "review_dismissed") & has_pr
    is_pull_raw = name.isin(*PULL_RAW_EVENTS) & has_pr
    on_pull = is_request | is_draft | is_commit | is_dismissed | is_pull_raw
    known_issue = name.isin(
        *objects, *ISSUE_PLAIN_EVENTS, *ISSUE_RAW_EVENTS, *REFERENCE_EVENTS, "edited", "renamed", "commented"
    )
    unknown = ~on_pull & ~known_issue
    unknown_on_pull = unknown & F.col("pull_request_id").isNotNull()

    title = F.coalesce("p.title", "p.issue.title")
    body = F.coalesce("p.body", "p.issue.body")
    is_edit = (name == "edited") & (title.isNotNull() | body.isNotNull())
    by_user = F.col("p.requested_reviewer").isNotNull()
    source_issue = _truthy(F.col("p.source.issue.id"))
    dismissed = F.coalesce(
        _truthy(F.col("p.dismissed_review.review_id")), _truthy(F.col("p.dismissed_review.id")), F.col("p.review_id")
    )

    subject_type = F.when(on_pull | unknown_on_pull, "pull_request").otherwise("issue")
    event_type = _chain(
        [(name == k, F.lit(v[0])) for k, v in ISSUE_OBJECT_EVENTS.items()]
        + [
            (is_edit | (name == "renamed"), F.lit("issue.content.edit")),
            (is_request & (name == "review_requested"), F.lit(REQUEST_EVENTS["review_requested"])),
            (is_request, F.lit(REQUEST_EVENTS["review_request_removed"])),
            (is_draft, F.lit("pull_request.draft.set")),
            (is_commit & (name == "synchronize"), F.lit(COMMIT_EVENTS["synchronize"])),
            (is_commit, F.lit(COMMIT_EVENTS["merged"])),
            (is_dismissed, F.lit("review.dismissed")),
            (is_pull_raw, F.concat(F.lit("pull_request."), name)),
            (known_issue, F.concat(F.lit("issue."), name)),
        ],
        F.concat(subject_type, F.lit(".event."), name),
    )
    object_type = _chain(
        [(name == k, F.lit(v[1])) for k, v in ISSUE_OBJECT_EVENTS.items()]
        + [
            (name == "commented", F.lit("comment")),
            (is_request, F.when(by_user, "user").otherwise("team")),
            (is_dismissed, F.lit("review")),
            (name.isin(*REFERENCE_EVENTS) & source_issue.isNotNull(), F.lit("issue")),
        ]
    )
    object_id = _chain(
        [(name == k, F.col(f"p.{v[2]}")) for k, v in ISSUE_OBJECT_EVENTS.items()]
        + [
            (name == "commented", F.coalesce(_truthy(F.col("p.comment.id")), F.col("p.comment_id"))),
            (is_request, F.when(by_user, F.col("p.requested_reviewer.id")).otherwise(F.col("p.requested_team.id"))),
            (is_dismissed, dismissed),
            (name.isin(*REFERENCE_EVENTS), source_issue),
        ]
    )
    needs_object = name.isin(*[k for k, v in ISSUE_OBJECT_EVENTS.items() if v[3]]) | is_request
    keeps_raw = (
        unknown | is_dismissed | is_pull_raw | name.isin(*ISSUE_RAW_EVENTS, *REFERENCE_EVENTS)
        | ((name == "edited") & ~is_edit)
    )
    event = F.struct(
            F.to_timestamp("p.created_at").alias("occurred_at"),
            F.col("p.actor.id").alias("actor_id"),
            subject_type.alias("subject_type"),
            F.when(subject_type == "pull_request", F.col("pull_request_id")).otherwise(F.col("issue_id")).alias("subject_id"),
            event_type.alias("event_type"),
            object_type.alias("object_type"),
            object_id.alias("object_id"),
            F.when(is_commit | name.isin(*REFERENCE_EVENTS), F.col("p.commit_id")).alias("commit_sha"),
            F.when(is_edit, title).when(name == "renamed", F.col("p.rename.to")).otherwise(null_s).alias("p_title"),
            F.when(is_edit, body).when(name == "commented", F.col("p.comment.body")).otherwise(null_s).alias("p_body"),
            F.when(is_draft, name == "converted_to_draft").otherwise(null_b).alias("p_is_draft"),
            null_s.alias("p_head_ref"),
            null_s.alias("p_state"),
            F.when(keeps_raw, F.col("payload")).alias("raw_payload"),
            needs_object.alias("_needs"),
    )
    return (
        rows.select("event_id", "repo_id", F.inline(F.array(event)))
        .filter(~F.col("_needs") | F.col("object_id").isNotNull())
        .drop("_needs")
    )


def _event(event_type: str, subject: str, subject_id: Column, at: Column, actor: Column, **extra: Column) -> Column:
    fields = {
        "occurred_at": at, "actor_id": actor, "subject_type": F.lit(subject), "subject_id": subject_id.cast("string"),
        "event_type": F.lit(event_type),
        "object_type": extra.get("object_type", F.lit(None)).cast("string"),
        "object_id": extra.get("object_id", F.lit(None)).cast("string"),
        "commit_sha": extra.get("commit_sha", F.lit(None)).cast("string"),
        "p_title": extra.get("title", F.lit(None)).cast("string"),
        "p_body": extra.get("body", F.lit(None)).cast("string"),
        "p_is_draft": extra.get("is_draft", F.lit(None)).cast("boolean"),
        "p_head_ref": extra.get("head_ref", F.lit(None)).cast("string"),
        "p_state": extra.get("state", F.lit(None)).cast("string"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _emit(rows: DataFrame, events: list[Column]) -> DataFrame:
    """One object becomes several events: a row-local explode, no shuffle."""
    return rows.select("repo_id", F.explode(F.array_compact(F.array(*events))).alias("e")).select("repo_id", "e.*")


def pull_request_events(prs: DataFrame) -> DataFrame:
    """Opened, head, draft, and then either merged or closed."""
    c = F.col
    at, who, pr = c("created_at"), c("author_id"), c("pr_id")
    return _emit(prs, [
        _event("pull_request.opened", "pull_request", pr, at, who),
        _event("pull_request.head.set", "pull_request", pr, at, who, commit_sha=c("head_sha"), head_ref=c("head_ref")),
        _event("pull_request.draft.set", "pull_request", pr, at, who, is_draft=F.coalesce(c("draft"), F.lit(False))),
        F.when(c("merged_at").isNotNull(), _event(
            "pull_request.merged", "pull_request", pr, c("merged_at"), who, commit_sha=c("merge_commit_sha")))
        .when(c("closed_at").isNotNull(), _event("pull_request.closed", "pull_request", pr, c("closed_at"), who)),
    ])


def issue_events(issues: DataFrame) -> DataFrame:
    c = F.col
    at, who, issue = c("created_at"), c("author_id"), c("issue_id")
    return _emit(issues, [
        _event("issue.opened", "issue", issue, at, who),
        _event("issue.content.set", "issue", issue, at, who, title=c("title"), body=c("body")),
        F.when(c("closed_at").isNotNull(), _event("issue.closed", "issue", issue, c("closed_at"), who)),
    ])


def comment_events(comments: DataFrame, parent: str = "pull_request") -> DataFrame:
    """Created, and edited when the update came later."""
    c = F.col
    args = {"object_type": F.lit(parent), "object_id": c("parent_id"), "body": c("body")}
    return _emit(comments, [
        _event("comment.created", "comment", c("comment_id"), c("created_at"), c("user_id"), **args),
        F.when(c("updated_at") > c("created_at"), _event(
            "comment.edited", "comment", c("comment_id"), c("updated_at"), c("user_id"), **args)),
    ])


def review_events(reviews: DataFrame) -> DataFrame:
    c = F.col
    return _emit(reviews, [_event(
        "review.submitted", "review", c("review_id"), c("submitted_at"), c("user_id"),
        object_type=F.lit("pull_request"), object_id=c("pr_id"), state=c("state"), body=c("body"))])
