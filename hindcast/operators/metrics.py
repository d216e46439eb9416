"""Routing agreement, gate correlation and queue metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.truth import OBSERVED, UNAVAILABLE, UNKNOWN

SLICES = ["all", "known_truth", "observed", "router_nonempty", "observed_and_router_nonempty"]


def agreement(labels: DataFrame, routes: DataFrame, routers: list[str]) -> DataFrame:
    """hit@1/3/5 and reciprocal rank per (policy, router, pull request).

    A pull request without truth, or a router without candidates, scores zero
    and still counts.
    """
    per_router = routes.filter(F.col("router_id").isin(*routers)).select("router_id", "pr_id", "rank", "target_name")
    # One row per (pull request, router): the ranked names, at most top-k of them.
    lists = per_router.groupBy("pr_id", "router_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_name"))), lambda s: s.target_name).alias("names"))
    framed = labels.withColumn("router_id", F.explode(F.array(*[F.lit(r) for r in routers]))).join(
        lists, ["pr_id", "router_id"], "left")
    position = F.coalesce(F.array_position("names", F.col("selected_login")), F.lit(0))
    hit = lambda k: F.when((position > 0) & (position <= k), 1.0).otherwise(0.0)
    return framed.select(
        "repo_id", "pr_id", "cutoff", "policy_id", "status", "router_id",
        (F.coalesce(F.size("names"), F.lit(0)) > 0).alias("router_nonempty"),
        hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"), hit(5).alias("hit_at_5"),
        F.when(position > 0, 1.0 / position).otherwise(0.0).alias("mrr"),
    )


def places(rows: DataFrame, lists: dict[str, str]) -> DataFrame:
    """(repo_id, pr_id, cutoff, policy_id, status, window_end, places): one row per (pull request, policy).

    ``rows`` hold the array ``truths`` (policy_id, status, selected_login, window_end) and for each router the column of
    its ranked names.  ``places``: per router whether it named anybody and the place of the responder, 0 if not named.
    """
    each = rows.select("repo_id", "pr_id", "cutoff", F.explode("truths").alias("t"), *lists.values())
    place = lambda c: F.coalesce(F.array_position(c, F.col("t.selected_login")), F.lit(0)).cast("int")
    return each.select("repo_id", "pr_id", "cutoff", "t.policy_id", "t.status", "t.window_end", F.array(*[
        F.struct(F.lit(r).alias("router_id"), (F.coalesce(F.size(c), F.lit(0)) > 0).alias("router_nonempty"), place(c).alias("place"))
        for r, c in lists.items()]).alias("places"))


def by_router(rows: DataFrame) -> DataFrame:
    """What ``agreement`` gives, from the rows of ``places``."""
    each = rows.select("repo_id", "pr_id", "cutoff", "policy_id", "status", F.inline("places"))
    hit = lambda k: F.when((F.col("place") > 0) & (F.col("place") <= k), 1.0).otherwise(0.0)
    return each.select(
        "repo_id", "pr_id", "cutoff", "policy_id", "status", "router_id", "router_nonempty", hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"),
        hit(5).alias("hit_at_5"), F.when(F.col("place") > 0, 1.0 / F.col("place")).otherwise(0.0).alias("mrr"))


METRICS = ["hit_at_1", "hit_at_3", "hit_at_5", "mrr"]


def mean_metrics(per_pr: DataFrame, keys: list[str]) -> DataFrame:
    return per_pr.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in METRICS])


def slice_condition(name: str) -> Column:
    observed = F.col("status") == OBSERVED
    return {
        "all": F.lit(True),
        "known_truth": ~F.col("status").isin(UNKNOWN, UNAVAILABLE),
        "observed": observed,
        "router_nonempty": F.col("router_nonempty"),
        "observed_and_router_nonempty": observed & F.col("router_nonempty"),
    }[name]


def sliced(per_pr: DataFrame, keys: list[str]) -> DataFrame:
    """The five overlapping slices of every key in one pass; empty slices stay, with null means."""
    aggs = [
        F.struct(
            F.lit(s).alias("slice"), F.count(F.when(slice_condition(s), 1)).alias("n"),
            *[F.avg(F.when(slice_condition(s), F.col(m))).alias(m) for m in METRICS],
        ).alias(f"_{s}")
        for s in SLICES
    ]
    return per_pr.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*[F.col(f"_{s}") for s in SLICES])))


def gate_correlation(gates: DataFrame, keys: list[str]) -> DataFrame:
    """Per gate field: how often it is missing and the merge rate with and without it."""
    fields = ["issue", "ai_disclosure", "provenance"]

    def one(f: str) -> Column:
        miss = F.col(f"missing_{f}")
        known = miss.isNotNull() & F.col("merged").isNotNull()
        merged = F.col("merged").cast("double")
        return F.struct(
            F.lit(f).alias("field"),
            F.count(F.when(known, 1)).alias("n"),
            F.count(F.when(known & miss, 1)).alias("missing_n"),
            F.count(F.when(known & ~miss, 1)).alias("present_n"),
            F.avg(F.when(known, miss.cast("double"))).alias("missing_rate"),
            F.avg(F.when(known & miss, merged)).alias("merged_rate_missing"),
            F.avg(F.when(known & ~miss, merged)).alias("merged_rate_present"),
        ).alias(f"_{f}")

    return gates.groupBy(*keys).agg(*[one(f) for f in fields]).select(
        *keys, F.inline(F.array(*[F.col(f"_{f}") for f in fields])))


def queue_times(cohort: DataFrame, reviews: DataFrame, comments: DataFrame, users: DataFrame) -> DataFrame:
    """Seconds from the cutoff to the first human review and comment by somebody else."""
    human = users.filter(F.col("type").isNull() | (F.col("type") != "Bot")).select("user_id")
    acted = reviews.select("pr_id", "user_id", F.col("submitted_at").alias("ts"), F.lit("r").alias("k")).unionByName(
        comments.select("pr_id", "user_id", F.col("created_at").alias("ts"), F.lit("c").alias("k")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    wait = (micros("ts") - micros("cutoff")) / 1e6
    first = (
        cohort.select("pr_id", "cutoff", "author_id").join(acted.join(human, "user_id"), "pr_id")
        .filter((F.col("ts") >= F.col("cutoff")) & (F.col("author_id").isNull() | (F.col("user_id") != F.col("author_id"))))
        .groupBy("pr_id").agg(F.min(F.when(F.col("k") == "r", wait)).alias("ttfr_seconds"),
                              F.min(F.when(F.col("k") == "c", wait)).alias("ttfc_seconds"))
    )
    return cohort.join(first, "pr_id", "left")


def queue_by_risk(times: DataFrame, keys: list[str]) -> DataFrame:
    return times.groupBy(*keys, F.lower(F.coalesce("risk", F.lit("unknown"))).alias("risk")).agg(
        F.count("*").alias("n"), F.avg("ttfr_seconds").alias("ttfr_seconds_mean"), F.avg("ttfc_seconds").alias("ttfc_seconds_mean"))


def rerank_cost(telemetry: DataFrame) -> DataFrame:
    """Latency and cost per router, with the run's total (router null)."""
    return telemetry.rollup("router_id").agg(
        F.count("*").alias("calls"), F.avg("latency_ms").alias("latency_ms_mean"), F.sum("cost_usd").alias("cost_usd"))
