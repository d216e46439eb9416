"""Feature registry and task policies as tables, and the checks that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.paths import glob_regex

# --- fixed values: feature name or pattern, value type, time semantics, granularity, role, deprecated ---
FEATURES = [
    ("pr.meta.author_type", "categorical", "static_at_cutoff", "pr", "context", False),
    ("pr.meta.created_at_ts", "count", "static_at_cutoff", "pr", "context", False),
    ("pr.meta.is_draft", "binary", "derived_snapshot", "pr", "gate", False),
    ("pr.meta.title_has_wip_signal", "binary", "static_at_cutoff", "pr", "gate", False),
    ("pr.meta.title_has_hotfix_signal", "binary", "static_at_cutoff", "pr", "context", False),
    ("pr.meta.mentions.count", "count", "static_at_cutoff", "pr", "context", False),
    ("pr.surface.changed_file_count", "count", "static_at_cutoff", "pr", "ranking", False),
    ("pr.surface.total_churn", "count", "static_at_cutoff", "pr", "ranking", False),
    ("pr.surface.max_file_churn", "count", "static_at_cutoff", "pr", "ranking", False),
    ("pr.surface.median_file_churn", "real", "static_at_cutoff", "pr", "ranking", False),
    ("pr.surface.status_ratio.*", "real", "static_at_cutoff", "pr", "context", False),
    ("pr.surface.distinct_directories_count.*", "count", "static_at_cutoff", "pr", "context", False),
    ("pr.surface.directory_entropy.*", "real", "static_at_cutoff", "pr", "context", False),
    ("pr.surface.extension_entropy", "real", "static_at_cutoff", "pr", "context", False),
    ("pr.surface.touches_*", "binary", "static_at_cutoff", "pr", "context", False),
    ("pr.gates.*", "binary", "static_at_cutoff", "pr", "gate", False),
    ("pr.gates.completeness_score", "real", "static_at_cutoff", "pr", "calibration", False),
    ("pr.boundary.set", "set", "static_at_cutoff", "set", "context", False),
    ("pr.boundary.count", "count", "static_at_cutoff", "pr", "context", False),
    ("pr.boundary.boundary_entropy", "real", "static_at_cutoff", "pr", "context", False),
    ("pr.ownership.owner_set", "set", "derived_snapshot", "set", "context", False),
    ("pr.ownership.owner_set_size", "count", "derived_snapshot", "pr", "context", False),
    ("pr.ownership.owner_coverage_ratio", "real", "derived_snapshot", "pr", "calibration", False),
    ("pr.trajectory.*", "count", "cumulative", "pr", "context", False),
    ("pr.trajectory.time_since_last_head_update_seconds", "real", "recency_based", "pr", "context", False),
    ("pr.trajectory.head_update_burstiness", "real", "recency_based", "pr", "context", False),
    ("pr.attention.*", "count", "cumulative", "pr", "calibration", False),
    ("pr.request_overlap.*", "real", "derived_snapshot", "pr", "context", False),
    ("pr.silence.*", "binary", "derived_snapshot", "pr", "calibration", False),
    ("pr.geometry.*", "real", "derived_snapshot", "pr", "context", False),
    ("repo.priors.*", "real", "derived_snapshot", "pr", "calibration", False),
    ("sim.nearest_prs.topk_ids", "set", "derived_snapshot", "set", "context", False),
    ("sim.nearest_prs.mean_ttfr_topk", "real", "derived_snapshot", "pr", "calibration", False),
    ("sim.nearest_prs.owner_overlap_rate_topk", "real", "derived_snapshot", "pr", "calibration", False),
    ("sim.nearest_prs.common_reviewers_topk", "set", "derived_snapshot", "set", "context", False),
    ("sim.nearest_prs.common_boundaries_topk", "set", "derived_snapshot", "set", "context", False),
    ("candidate.profile.type", "categorical", "static_at_cutoff", "candidate", "context", False),
    ("candidate.profile.is_bot", "binary", "static_at_cutoff", "candidate", "gate", False),
    ("candidate.profile.account_age_days", "real", "recency_based", "candidate", "context", False),
    ("candidate.activity.last_seen_seconds", "real", "recency_based", "candidate", "ranking", False),
    ("candidate.activity.event_counts_*", "count", "recency_based", "candidate", "ranking", False),
    ("candidate.activity.*_180d", "count", "cumulative", "candidate", "ranking", False),
    ("candidate.activity.load_proxy.open_reviews_est", "count", "derived_snapshot", "candidate", "calibration", False),
    ("candidate.footprint.*", "set", "derived_snapshot", "candidate", "context", False),
    ("pair.affinity.*", "real", "derived_snapshot", "pair", "ranking", False),
    ("pair.social.*", "real", "cumulative", "pair", "ranking", False),
    ("pair.availability.recency_seconds", "real", "recency_based", "pair", "ranking", False),
    ("pair.availability.historical_response_rate_bucket", "ordinal", "derived_snapshot", "pair", "calibration", False),
    ("pair.availability.is_already_participating", "binary", "cumulative", "pair", "context", False),
    ("automation.bot_comment_count", "count", "cumulative", "pr", "context", False),
    ("automation.bot_authors.distinct_count", "count", "cumulative", "pr", "context", False),
    ("automation.bot_categories.*", "count", "cumulative", "pr", "context", False),
    ("automation.has_*", "binary", "cumulative", "pr", "context", False),
    ("labels.*", "binary", "derived_snapshot", "pr", "calibration", False),
    ("debug.*", "categorical", "static_at_cutoff", "pr", "context", False),
    ("pr.files.*", "count", "static_at_cutoff", "pr", "context", True),
    ("pr.churn.*", "count", "static_at_cutoff", "pr", "context", True),
    ("pr.paths.*", "real", "static_at_cutoff", "pr", "context", True),
    ("pr.text.*", "real", "static_at_cutoff", "pr", "context", True),
    ("pr.timeline.*", "real", "cumulative", "pr", "context", True),
    ("pr.owners.*", "real", "derived_snapshot", "pr", "context", True),
    ("cand.activity.*", "real", "recency_based", "candidate", "context", True),
    ("x.*", "real", "derived_snapshot", "pair", "ranking", True),
]
# --- fixed values: task, roles, granularities, key prefixes ---
TASKS = [
    ("T02", ["gate", "context", "calibration"], ["pr", "set"], ["pr.", "repo.priors.", "automation."]),
    ("T04", ["context", "calibration", "gate"], ["pr", "set"], ["pr.ownership.", "pr.boundary.", "pr.surface.", "repo.priors."]),
    (
        "T06",
        ["ranking", "context", "calibration"],
        ["pair", "candidate", "pr", "set"],
        ["pair.", "candidate.", "pr.boundary.", "pr.surface.", "pr.request_overlap.", "pr.attention.", "repo.priors.", "sim."],
    ),
    ("T09", ["calibration", "context", "gate"], ["pr", "candidate", "pair", "set"], ["pr.", "candidate.", "pair.availability.", "repo.priors.", "automation."]),
    ("T10", ["calibration", "context"], ["pair", "pr", "candidate", "set"], ["pair.availability.", "pr.", "candidate.", "repo.priors."]),
]


def feature_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURES, "name string, value_type string, temporal string, granularity string, role string, deprecated boolean")


def task_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "task_id string, roles array<string>, granularities array<string>, prefixes array<string>")


def classify(keys: DataFrame, specs: DataFrame) -> DataFrame:
    """Spec of each distinct key: the exact one, else the first pattern in name order.

    The registry is a table of a few dozen rows, so it travels to the keys.
    """
    rx = specs.filter(F.col("name").contains("*")).withColumn("rx", glob_regex(F.col("name")))
    exact = specs.filter(~F.col("name").contains("*"))
    distinct = keys.select("key").distinct()
    spec = F.struct("name", "value_type", "granularity", "role")
    by_name = distinct.join(F.broadcast(exact), F.col("key") == F.col("name"), "left").select("key", F.when(F.col("name").isNotNull(), spec).alias("e"))
    patterns = rx.agg(F.array_sort(F.collect_list(F.struct("name", "value_type", "granularity", "role", "rx"))).alias("ps")).withColumn("_one", F.lit(1))
    return (
        by_name.withColumn("_one", F.lit(1)).join(F.broadcast(patterns), "_one")
        .withColumn("p", F.expr("try_element_at(filter(ps, s -> key rlike s.rx), 1)"))
        .select("key", F.coalesce(F.col("e"), F.when(F.col("p").isNotNull(), F.struct("p.name", "p.value_type", "p.granularity", "p.role"))).alias("s"))
        .select("key", F.col("s.name").alias("spec"), F.col("s.granularity").alias("granularity"), F.col("s.role").alias("role"))
    )


def coverage(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("feature_count"), F.count("spec").alias("resolved_count"),
        F.count(F.when(F.col("spec").isNull(), 1)).alias("unresolved_count"))


def violations(classified: DataFrame, policies: DataFrame) -> DataFrame:
    """(task_id, key, reason): resolved keys a task may not use."""
    tasks = policies.agg(F.collect_list(F.struct("task_id", "roles", "granularities", "prefixes")).alias("ts")).withColumn("_one", F.lit(1))
    rows = classified.filter(F.col("spec").isNotNull()).withColumn("_one", F.lit(1)).join(F.broadcast(tasks), "_one").select(
        "key", "role", "granularity", F.explode("ts").alias("t"))
    fits = F.exists("t.prefixes", lambda p: F.col("key").startswith(p))
    reason = (
        F.when(~fits, "prefix_not_allowed").when(~F.array_contains("t.roles", F.col("role")), "role_not_allowed")
        .when(~F.array_contains("t.granularities", F.col("granularity")), "granularity_not_allowed"))
    return rows.select(F.col("t.task_id").alias("task_id"), "key", reason.alias("reason")).filter(F.col("reason").isNotNull())


def quality_rollup(classified: DataFrame, found: DataFrame) -> DataFrame:
    """Unresolved keys and violations per task in one table."""
    return found.groupBy("task_id").agg(F.count("*").alias("n")).unionByName(
        classified.agg(F.lit("unresolved").alias("task_id"), F.count(F.when(F.col("spec").isNull(), 1)).alias("n")))
