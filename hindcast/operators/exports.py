"""Exported tables of a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions import paths as P
from hindcast.functions import text as X


def pr_rows(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """One row per pull request with its gates and file count."""
    counts = files.groupBy("pr_id").agg(F.count("*").alias("n_changed_files"))
    body = F.col("as_of_body")
    return snapshots.join(counts, "pr_id", "left").select(
        "repo_id", "pr_id", "cutoff", "author_login", "created_at", "base_sha", "head_sha",
        F.coalesce("n_changed_files", F.lit(0)).alias("n_changed_files"),
        X.gate_issue(body).isNull().alias("missing_issue"), X.gate_ai_disclosure(body).isNull().alias("missing_ai_disclosure"),
        X.gate_provenance(body).isNull().alias("missing_provenance"))


def file_rows(files: DataFrame) -> DataFrame:
    return files.withColumn("default_boundary", P.default_boundary(F.col("path")))


def activity_rows(participation: DataFrame, review_states: DataFrame, start: Column, end: Column) -> DataFrame:
    """The activity stream of a time window with the state of reviews."""
    return (
        participation.filter((F.col("ts") >= start) & (F.col("ts") <= end))
        .join(review_states.select(F.col("review_id").alias("row_id"), "state"), "row_id", "left")
        .select("repo_id", "pr_id", F.col("ts").alias("occurred_at"), F.col("login").alias("actor_login"),
                F.col("type").alias("actor_type"), "kind", F.when(F.col("kind") == "review_submitted", F.col("state")).alias("review_state"))
    )


def activity_counts(participation: DataFrame) -> DataFrame:
    """How often each kind of activity occurs, most frequent first."""
    return participation.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kind")
