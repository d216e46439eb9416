"""Summaries of a run and comparisons between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["hit_at_1", "hit_at_3", "hit_at_5", "mrr"]


def _side(df: DataFrame, keys: list[str], values: list[str], tag: str) -> DataFrame:
    return df.select(*keys, *[F.col(v).alias(f"{tag}_{v}") for v in values])


def align(baseline: DataFrame, candidate: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows both runs have, side by side with candidate-minus-baseline deltas."""
    joined = _side(baseline, keys, values, "baseline").join(_side(candidate, keys, values, "candidate"), keys)
    return joined.select("*", *[(F.col(f"candidate_{v}") - F.col(f"baseline_{v}")).alias(f"delta_{v}") for v in values])


def same_cohort(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(repo_id, cohort_match) from the cohort hashes of two runs."""
    return baseline.select("repo_id", F.col("cohort_hash").alias("b")).join(
        candidate.select("repo_id", F.col("cohort_hash").alias("c")), "repo_id", "full_outer").select(
        "repo_id", F.coalesce(F.col("b") == F.col("c"), F.lit(False)).alias("cohort_match"))


def router_deltas(baseline: DataFrame, candidate: DataFrame, cohorts: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Router metrics side by side; only repositories with equal cohorts unless forced."""
    rows = align(baseline, candidate, ["repo_id", "router_id"], ["n", *METRICS])
    if cohorts is not None and not force:
        rows = rows.join(cohorts.filter("cohort_match").select("repo_id"), "repo_id", "left_semi")
    return rows


def regressed_slices(baseline: DataFrame, candidate: DataFrame, limit: int = 20) -> DataFrame:
    """The slices that lost most reciprocal rank."""
    rows = align(baseline, candidate, ["policy_id", "router_id", "slice"], ["n", "mrr", "hit_at_1"])
    return rows.filter(F.round("delta_mrr", 12) < 0).orderBy(F.round("delta_mrr", 12), F.lower("policy_id"), F.lower("router_id"), F.lower("slice")).limit(limit)


def regressed_examples(baseline: DataFrame, candidate: DataFrame, policy_id: str, limit: int = 20) -> DataFrame:
    """The pull requests that lost most reciprocal rank, observed in both runs."""
    observed = (F.col("policy_id") == policy_id) & (F.col("status") == "observed")
    # Only who scored can lose.
    rows = align(baseline.filter(observed & (F.col("mrr") > 0)), candidate.filter(observed), ["pr_id", "router_id", "policy_id"], ["mrr", "hit_at_1"])
    return rows.filter(F.round("delta_mrr", 12) < 0).orderBy(F.round("delta_mrr", 12), "pr_id", F.lower("router_id")).limit(limit)


def gate_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Gates of both runs, whether or not the other has them."""
    return _side(baseline, ["gate_id"], ["pass", "value"], "baseline").join(
        _side(candidate, ["gate_id"], ["pass", "value"], "candidate"), "gate_id", "full_outer"
    ).withColumn("delta_value", F.col("candidate_value") - F.col("baseline_value"))


def count_deltas(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of both runs over the union of their keys; absent means zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = _side(baseline, keys, ["n"], "baseline").join(_side(candidate, keys, ["n"], "candidate"), keys, "full_outer").select(
        *keys, zero("baseline_n"), zero("candidate_n"))
    return joined.withColumn("delta_n", F.col("candidate_n") - F.col("baseline_n"))


def worst_slices(slices: DataFrame, limit: int = 20) -> DataFrame:
    """Non-empty slices with the lowest reciprocal rank first, larger ones before smaller."""
    return slices.filter((F.col("n") > 0) & F.col("mrr").isNotNull()).orderBy(
        F.round("mrr", 12), F.col("n").desc(), F.lower("router_id"), F.lower("slice")).limit(limit)


def run_summary(per_pr: DataFrame, keys: list[str]) -> DataFrame:
    """Headline numbers per run and router with the range of cutoffs."""
    return per_pr.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(m).alias(m) for m in METRICS],
        F.min("cutoff").alias("min_cutoff"), F.max("cutoff").alias("max_cutoff"))


def index_examples(current: DataFrame, incoming: DataFrame, complete_runs: DataFrame) -> DataFrame:
    """Cross-run index: one row per (run, pull request, router, policy), complete runs only."""
    from hindcast.operators.upsert import upsert

    fresh = incoming.join(complete_runs.select("run_id"), "run_id", "left_semi")
    return upsert(current, fresh, ["run_id", "pr_id", "router_id", "policy_id"], ["loaded_at"])


def first_examples(per_pr: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the first correct and the first incorrect observed example."""
    correct = F.col("hit_at_1") > 0
    observed = per_pr.filter(F.col("status") == "observed")
    rank = F.struct(*order)
    pick = lambda cond, name: F.min_by(F.when(cond, F.col("pr_id")), F.when(cond, rank)).alias(name)
    return observed.groupBy(*keys).agg(pick(correct, "first_correct"), pick(~correct, "first_incorrect"))


def flatten_run_rows(rows: DataFrame, routers: list[str], policy: str) -> DataFrame:
    """Audit table from nested per-PR run rows (one JSON object per pull request)."""
    def one(r: str) -> Column:
        base = F.col("routers")[r]
        return F.struct(
            F.lit(r).alias("router_id"), base["route_result"]["risk"].alias("risk"),
            F.size(base["route_result"]["candidates"]).alias("n_candidates"),
            base["routing_agreement_by_policy"][policy]["mrr"].alias("mrr"),
            base["routing_agreement_by_policy"][policy]["hit_at_1"].alias("hit_at_1"))
    return rows.select("repo", "run_id", "pr_number", "cutoff", F.col("truth.policies")[policy]["status"].alias("status"),
                       F.inline(F.array(*[one(r) for r in routers])))


def ranked_within(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")
