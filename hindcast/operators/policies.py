"""Truth policies as a table of rules: selectors first, last, union and priority_chain.

A policy becomes branches in order of preference, a branch becomes one rule per
source.  All policies are answered by one join of the evidence with the rules;
nobody's evidence is gathered into one row: targets, branches and answers are
three partial aggregations.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.text import is_bot
from hindcast.operators.asof import request_targets
from hindcast.operators.truth import BUILTIN_POLICIES, NO_RESPONSE, OBSERVED, UNAVAILABLE, UNKNOWN, TruthPolicy, gap_flags

Branch = tuple[TruthPolicy, tuple[str, ...], str]
IDS = ["repo_id", "pr_id", "cutoff"]
_EVIDENCE = ["pr_id", "source", "target", "user_id", "login", "type", "ts", "row_id", "label"]
_RULES = ("policy_id string, branch int, selector string, source string, window_seconds long, exclude_bots boolean, "
          "exclude_author boolean, labels array<string>")

# --- fixed values -----------------------------------------------------------------
MERGED = "pull_request.merged"
SOURCES = ("reviews", "review_comments", "events", "review_requests")

_merging = {"exclude_bots": False, "exclude_author": False, "params": {"event_types": [MERGED], "needs_coverage": False}}
POLICIES = [replace(p, ready=True, **(_merging if p.id == "merger_v1" else {})) for p in BUILTIN_POLICIES]


def branches(policy: TruthPolicy, known: Mapping[str, TruthPolicy], path: tuple[str, ...] = ()) -> list[Branch]:
    """(policy whose filters hold, sources, selector) in order of preference.

    A priority chain tries the branches of its fallbacks, each with its own window
    and filters, and then its own sources one by one.
    """
    if policy.id in path:
        raise ValueError(f"truth policies fall back on each other: {' > '.join((*path, policy.id))}")
    unknown = [s for s in policy.sources if s not in SOURCES]
    if unknown or policy.selector not in ("first", "last", "union", "priority_chain"):
        raise ValueError(f"truth policy {policy.id} has an unknown source or selector: {unknown or policy.selector}")
    if policy.selector != "priority_chain":
        return [(policy, policy.sources, policy.selector)]
    out: list[Branch] = []
    for name in policy.fallback_chain:
        if name not in known:
            raise ValueError(f"truth policy {policy.id} falls back on an unknown policy: {name}")
        out += branches(known[name], known, (*path, policy.id))
    return out + [(policy, (s,), "first") for s in policy.sources]


def _rules(policies: Sequence[TruthPolicy], known: Mapping[str, TruthPolicy], window_seconds: int | None) -> list[tuple]:
    out = []
    for p in policies:
        for i, (held, sources, selector) in enumerate(branches(p, known)):
            for s in sources:
                wanted = {"reviews": held.review_states, "events": held.params.get("event_types", ())}.get(s, ())
                out.append((p.id, i, selector, s, window_seconds or held.window_seconds, held.exclude_bots, held.exclude_author, list(wanted)))
    return out


def evidence(responses: DataFrame, events: DataFrame, requests: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """What a policy may choose from, one row per act.

    ``responses`` as ``truth.responses`` makes them; ``events``: (pr_id, user_id, ts, row_id,
    event_type); ``requests``: review-request intervals.  Acts without a time, a login or a
    known target drop out.
    """
    user = lambda login: F.concat(F.lit("user:"), login)
    answered = responses.select(
        "pr_id", F.when(F.col("kind") == "review_submitted", "reviews").otherwise("review_comments").alias("source"),
        user(F.col("login")).alias("target"), "user_id", "login", "type", "ts", "row_id", F.col("state").alias("label"))
    acted = events.join(users.select("user_id", "login", "type"), "user_id").select(
        "pr_id", F.lit("events").alias("source"), user(F.col("login")).alias("target"), "user_id", "login", "type", "ts", "row_id",
        F.col("event_type").alias("label"))
    is_user = F.col("target_type") == "user"
    asked = request_targets(requests, users, teams).select(
        "pr_id", F.lit("review_requests").alias("source"), F.concat_ws(":", "target_type", "target_name").alias("target"),
        F.when(is_user, F.col("reviewer_id")).alias("user_id"), F.when(is_user, F.col("target_name")).alias("login"),
        F.lit(None).cast("string").alias("type"), F.col("start_ts").alias("ts"),
        F.concat_ws(":", "target_type", "target_name").alias("row_id"), F.lit("").alias("label"))
    rows = answered.select(*_EVIDENCE).unionByName(acted.select(*_EVIDENCE)).unionByName(asked.select(*_EVIDENCE))
    return rows.filter(F.col("target").isNotNull() & F.col("ts").isNotNull())


def _until(seconds: Column) -> Column:
    return F.col("cutoff") + F.make_dt_interval(secs=seconds)


def selected(cohort: DataFrame, rows: DataFrame, policies: Sequence[TruthPolicy], window_seconds: int | None = None,
             known: Sequence[TruthPolicy] = POLICIES) -> DataFrame:
    """The targets each policy chooses: (repo_id, pr_id, cutoff, policy_id, branch, target, first_ts).

    The first branch with any eligible act decides.  ``first`` and ``last`` choose
    one target (ties by row id, then target), ``union`` every target of the branch.
    Windows are open at the cutoff and closed at their end.
    """
    table = _rules(policies, {p.id: p for p in [*known, *policies]}, window_seconds)
    widest = max([r[4] for r in table], default=0)
    rules = F.broadcast(rows.sparkSession.createDataFrame(table, _RULES))  # a few rows per policy
    eligible = (
        (F.col("ts") <= _until(F.col("window_seconds")))
        & ((F.size("labels") == 0) | F.array_contains("labels", F.coalesce("label", F.lit(""))))
        & ~(F.col("exclude_bots") & is_bot(F.col("type"), F.col("login")))
        & ~(F.col("exclude_author") & F.coalesce(F.col("user_id") == F.col("author_id"), F.lit(False)))
    )
    met = (
        cohort.select(*IDS, "author_id").distinct().join(rows, "pr_id")
        .filter((F.col("ts") > F.col("cutoff")) & (F.col("ts") <= _until(F.lit(widest)))).join(rules, "source").filter(eligible)
    )
    key = [*IDS, "policy_id", "branch", "selector"]
    at = F.struct("ts", "row_id")
    targets = met.groupBy(*key, "target").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    decided = targets.groupBy(*key).agg(
        F.min_by("target", F.struct("first", "target")).alias("earliest"), F.max_by("target", F.struct("last", "target")).alias("latest"),
    ).groupBy(*IDS, "policy_id").agg(F.min(F.struct("branch", "selector", "earliest", "latest")).alias("best"))
    chosen = decided.select(
        *IDS, "policy_id", "best.branch", "best.selector",
        F.when(F.col("best.selector") == "last", F.col("best.latest")).otherwise(F.col("best.earliest")).alias("only"))
    return targets.join(chosen, key).filter((F.col("selector") == "union") | (F.col("target") == F.col("only"))).select(
        *IDS, "policy_id", "branch", "target", F.col("first.ts").alias("first_ts"))


def answers(cohort: DataFrame, rows: DataFrame, horizons: DataFrame, gaps: DataFrame, policies: Sequence[TruthPolicy],
            available: Collection[str] = SOURCES, window_seconds: int | None = None, known: Sequence[TruthPolicy] = POLICIES) -> DataFrame:
    """One row per (pull request, policy): deciding branch, number of targets, the target if it is one, status.

    A policy that needs a source which is not ``available`` is reported unavailable.
    ``needs_coverage`` false in a policy's params makes every silence a real one.
    """
    by_id = {p.id: p for p in [*known, *policies]}
    parts = {p.id: branches(p, by_id) for p in policies}
    ready = [p for p in policies if all(s in available for _, sources, _ in parts[p.id] for s in sources)]
    listed = F.array(*[
        F.struct(
            F.lit(p.id).alias("policy_id"), F.lit(p in ready).alias("_ready"), F.lit(p.params.get("needs_coverage", True)).alias("_needs"),
            F.lit(max(window_seconds or held.window_seconds for held, _, _ in parts[p.id])).cast("long").alias("_window"))
        for p in policies])
    found = selected(cohort, rows, ready, window_seconds, known).groupBy(*IDS, "policy_id").agg(
        F.min("branch").alias("branch"), F.count("*").alias("n_targets"), F.min("target").alias("_target"))
    out = (
        cohort.select(*IDS).distinct().select(*IDS, F.inline(listed)).join(found, [*IDS, "policy_id"], "left")
        .join(horizons, "repo_id", "left").join(gap_flags(gaps), "repo_id", "left")
        .withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))
    )
    complete = F.coalesce(F.col("horizon_max") >= _until(F.col("_window")), F.lit(False)) & F.col("gap_resources").isNull()
    status = (
        F.when(~F.col("_ready"), UNAVAILABLE).when(F.col("n_targets") > 0, OBSERVED)
        .when(~F.col("_needs") | complete, NO_RESPONSE).otherwise(UNKNOWN)
    )
    return out.select(*IDS, "policy_id", "branch", "n_targets", F.when(F.col("n_targets") == 1, F.col("_target")).alias("target"), status.alias("status"))
