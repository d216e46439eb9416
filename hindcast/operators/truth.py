"""Truth labels: who really responded after the cutoff, and how sure we are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.text import is_bot
from hindcast.operators.asof import request_targets, valid_at

# --- fixed values -----------------------------------------------------------------
OBSERVED = "observed"
NO_RESPONSE = "no_post_cutoff_response"
UNKNOWN = "unknown_due_to_ingestion_gap"
UNAVAILABLE = "policy_unavailable"
STATUSES = [OBSERVED, NO_RESPONSE, UNKNOWN, UNAVAILABLE]
GAP_RESOURCES = ["reviews", "review_comments", "issue_comments", "issue_events", "pulls", "issues"]


@dataclass(frozen=True)
class TruthPolicy:
    """A truth policy as data.  ``ready`` policies are run; others are reported unavailable."""

    id: str
    window_seconds: int = 3600
    sources: tuple[str, ...] = ("reviews",)
    review_states: tuple[str, ...] = ()
    exclude_bots: bool = True
    exclude_author: bool = True
    selector: str = "first"
    fallback_chain: tuple[str, ...] = ()
    version: str = "v1"
    ready: bool = True
    params: dict = field(default_factory=dict)


BUILTIN_POLICIES = [
    TruthPolicy("first_response_v1", 3600, ("reviews", "review_comments")),
    TruthPolicy("first_approval_v1", 3600, ("reviews",), ("APPROVED",)),
    TruthPolicy("merger_v1", 48 * 3600, ("events",), ready=False),
    TruthPolicy("hybrid_owner_v1", 48 * 3600, ("reviews", "events", "review_requests"), selector="priority_chain",
                fallback_chain=("first_approval_v1", "merger_v1", "first_response_v1"), ready=False),
]


def responses(reviews: DataFrame, comments: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Reviews and review comments, one row each, with the acting user (without ``users``: only the user's id)."""
    rows = reviews.filter(F.col("submitted_at").isNotNull()).select(
        "pr_id", "user_id", F.col("submitted_at").alias("ts"), F.col("review_id").alias("row_id"),
        F.upper(F.coalesce("state", F.lit(""))).alias("state"), F.lit("review_submitted").alias("kind"),
    ).unionByName(
        comments.filter(F.col("review_id").isNotNull() & F.col("created_at").isNotNull()).select(
            "pr_id", "user_id", F.col("created_at").alias("ts"), F.col("comment_id").alias("row_id"),
            F.lit("").alias("state"), F.lit("review_comment").alias("kind"))
    )
    return rows if users is None else named(rows, users)


def named(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of known users with their login and type."""
    return rows.join(users.filter(F.col("login").isNotNull()).select("user_id", "login", "type"), "user_id")


def near(rows: DataFrame, cohort: DataFrame, window_seconds: int) -> DataFrame:
    """The rows later than the first cutoff of their pull request and no later than ``window_seconds`` after its last."""
    bounds = cohort.groupBy("pr_id").agg(F.min("cutoff").alias("_after"), F.max("cutoff").alias("_until"))
    return rows.join(bounds, "pr_id").filter(
        (F.col("ts") > F.col("_after")) & (F.col("ts") <= F.col("_until") + F.expr(f"interval '{window_seconds}' second"))).drop("_after", "_until")


def gap_flags(gaps: DataFrame) -> DataFrame:
    """Repositories with an ingestion gap in a resource the truth depends on."""
    return gaps.filter(F.col("resource").isin(*GAP_RESOURCES)).groupBy("repo_id").agg(
        F.array_join(F.array_sort(F.collect_set("resource")), ",").alias("gap_resources"))


def label(
    cohort: DataFrame, rows: DataFrame, horizons: DataFrame, gaps: DataFrame, policies: list[TruthPolicy],
    window_seconds: int | None = None, users: DataFrame | None = None,
) -> DataFrame:
    """One row per (pull request, policy): the selected responder, counts and status.

    ``cohort``: (repo_id, pr_id, cutoff, author_id).  All policies are answered by
    one pass over the responses; ``window_seconds`` overrides every policy's own.
    The window is open at the cutoff and closed at its end.  With ``users`` the rows carry ids only and
    get their names inside the window: what lies outside never moves to the users.
    """
    ready = [p for p in policies if p.ready]
    width = {p.id: window_seconds or p.window_seconds for p in policies}
    ids = ["repo_id", "pr_id", "cutoff"]
    end = lambda p: F.col("cutoff") + F.expr(f"interval '{width[p.id]}' second")

    def in_window(p: TruthPolicy) -> Column:
        return F.col("ts") <= end(p)

    def eligible(p: TruthPolicy) -> Column:
        kinds = [k for s, k in (("reviews", "review_submitted"), ("review_comments", "review_comment")) if s in p.sources]
        cond = in_window(p) & F.col("kind").isin(*kinds)
        if p.exclude_bots:
            cond = cond & ~is_bot(F.col("type"), F.col("login"))
        if p.exclude_author:
            cond = cond & (F.col("author_id").isNull() | (F.col("user_id") != F.col("author_id")))
        if p.review_states:
            cond = cond & ((F.col("kind") != "review_submitted") | F.col("state").isin(*p.review_states))
        return cond

    aggregates = []
    for i, p in enumerate(ready):
        scanned = lambda kind: F.count(F.when(in_window(p) & (F.col("kind") == kind), 1))  # noqa: B023, E731
        picked = F.struct("login", F.col("kind").alias("source"), "row_id")
        order = F.struct("ts", "row_id", "kind")
        choose = F.max_by if p.selector == "last" else F.min_by
        aggregates += [
            choose(F.when(eligible(p), picked), F.when(eligible(p), order)).alias(f"_pick{i}"),
            F.count(F.when(eligible(p), 1)).alias(f"_eligible{i}"),
            scanned("review_submitted").alias(f"_reviews{i}"),
            (scanned("review_comment") if "review_comments" in p.sources else F.lit(0)).alias(f"_comments{i}"),
        ]
    widest = max([width[p.id] for p in ready], default=0)
    near = cohort.select(*ids, "author_id").join(rows, "pr_id").filter(
        (F.col("ts") > F.col("cutoff")) & (F.col("ts") <= F.col("cutoff") + F.expr(f"interval '{widest}' second")))
    found = (near if users is None else named(near, users)).groupBy(*ids).agg(*aggregates)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_policy = []
    for p in policies:
        i = ready.index(p) if p.ready else None
        per_policy.append(F.struct(
            F.lit(p.id).alias("policy_id"),
            F.lit(p.ready).alias("_ready"),
            end(p).alias("window_end"),
            (F.col(f"_pick{i}.login") if p.ready else F.lit(None).cast("string")).alias("selected_login"),
            (F.col(f"_pick{i}.source") if p.ready else F.lit(None).cast("string")).alias("selected_source"),
            (F.col(f"_pick{i}.row_id") if p.ready else F.lit(None).cast("string")).alias("selected_row_id"),
            (zero(f"_eligible{i}") if p.ready else F.lit(0)).cast("bigint").alias("eligible_candidates"),
            (zero(f"_reviews{i}") if p.ready else F.lit(0)).cast("bigint").alias("scanned_reviews"),
            (zero(f"_comments{i}") if p.ready else F.lit(0)).cast("bigint").alias("scanned_review_comments"),
        ))
    labelled = (
        cohort.select(*ids, "author_id").join(found, ids, "left")
        .select(*ids, F.inline(F.array(*per_policy)))
        .join(horizons, "repo_id", "left").join(gap_flags(gaps), "repo_id", "left")
    )
    complete = F.col("horizon_max").isNotNull() & (F.col("horizon_max") >= F.col("window_end")) & F.col("gap_resources").isNull()
    status = (
        F.when(~F.col("_ready"), UNAVAILABLE).when(F.col("selected_login").isNotNull(), OBSERVED)
        .when(complete, NO_RESPONSE).otherwise(UNKNOWN)
    )
    return labelled.withColumn("coverage_complete", F.col("_ready") & complete).withColumn("status", status).drop("_ready")


def requested_at_cutoff(cohort: DataFrame, requests: DataFrame, users: DataFrame, teams: DataFrame,
                        window_seconds: int = 3600) -> DataFrame:
    """Intent: requests active at the cutoff that started within the window before it."""
    active = (
        cohort.select("pr_id", "cutoff").join(requests, "pr_id")
        .filter(valid_at(F.col("cutoff")) & (F.col("start_ts") >= F.col("cutoff") - F.expr(f"interval '{window_seconds}' second")))
    )
    return request_targets(active, users, teams).select(
        "pr_id", F.concat_ws(":", "target_type", "target_name").alias("target")).distinct()


def requested_after_cutoff(cohort: DataFrame, requests: DataFrame, users: DataFrame, teams: DataFrame,
                           window_seconds: int = 3600) -> DataFrame:
    """Exported intent: requests that start in ``[cutoff, cutoff + window]``."""
    started = (
        cohort.select("pr_id", "cutoff").join(requests, "pr_id")
        .filter((F.col("start_ts") >= F.col("cutoff"))
                & (F.col("start_ts") <= F.col("cutoff") + F.expr(f"interval '{window_seconds}' second")))
    )
    return request_targets(started, users, teams).select(
        "pr_id", "cutoff", F.col("start_ts").alias("requested_at"), "target_type", "target_name")


def first_reviewer(cohort: DataFrame, rows: DataFrame) -> DataFrame:
    """Exported behaviour: the first human, non-author review after the cutoff, however late."""
    who = (
        cohort.select("pr_id", "cutoff", "author_id")
        .join(rows.filter((F.col("kind") == "review_submitted") & ~is_bot(F.col("type"), F.col("login"))), "pr_id")
        .filter((F.col("ts") > F.col("cutoff")) & (F.col("author_id").isNull() | (F.col("user_id") != F.col("author_id"))))
        .groupBy("pr_id").agg(F.min_by("login", F.struct("ts", "row_id")).alias("first_reviewer"))
    )
    return cohort.select("pr_id", "cutoff").join(who, "pr_id", "left")


def status_histogram(labels: DataFrame) -> DataFrame:
    """Counts per policy and status; statuses that never occur count zero."""
    counts = labels.groupBy("policy_id").agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES])
    return counts.select("policy_id", F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES])))
