"""High-watermark loading, page gaps and the ingestion quality report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_time_window(created: Column, updated: Column | None, start: datetime | None, end: datetime | None) -> Column:
    """Objects whose [created, updated] overlaps the window; unknown times pass."""
    last = created if updated is None else F.coalesce(updated, created)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (last.isNull() | (last >= F.lit(start)))
    if end is not None:
        cond = cond & (created.isNull() | (created <= F.lit(end)))
    return cond


def link_pull_requests(prs: DataFrame, issues: DataFrame) -> DataFrame:
    """Fill ``issue_id`` of pull requests from the issue with the same number."""
    found = issues.select("repo_id", "number", F.col("issue_id").alias("_found"))
    return (
        prs.join(found, ["repo_id", "number"], "left")
        .withColumn("issue_id", F.coalesce("_found", "issue_id"))
        .drop("_found")
    )


def newer_than_watermark(rows: DataFrame, watermarks: DataFrame, resource: str) -> DataFrame:
    """Rows at or after their repository's watermark; all rows where there is none."""
    marks = watermarks.filter(F.col("resource") == resource).select("repo_id", F.col("updated_at").alias("_mark"))
    return rows.join(marks, "repo_id", "left").filter(
        F.col("_mark").isNull() | (F.col("updated_at") >= F.col("_mark"))
    ).drop("_mark")


def advance_watermarks(previous: DataFrame, seen: DataFrame) -> DataFrame:
    """New watermark per (repo, resource): what was seen, else what was stored."""
    newest = seen.groupBy("repo_id", "resource").agg(F.max("updated_at").alias("_seen"))
    return previous.join(newest, ["repo_id", "resource"], "full_outer").select(
        "repo_id", "resource", F.coalesce("_seen", "updated_at").alias("updated_at")
    )


def touched_only(rows: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Restrict a rebuild to the keys an incremental load has touched."""
    return rows.join(touched.select(key).distinct(), key, "left_semi")


def page_gaps(pages: DataFrame) -> DataFrame:
    """Gaps in a landed page log (repo_id, resource, page, items, next_page)."""
    empty = (F.col("items") == 0) & F.col("next_page").isNotNull()
    jump = F.col("next_page").isNotNull() & (F.col("next_page") != F.col("page") + 1)
    gap = lambda cond, page, expected, detail: F.when(cond, F.struct(
        page.alias("page"), expected.alias("expected_page"), F.lit(detail).alias("detail")))
    return pages.select(
        "repo_id", "resource",
        F.explode(F.array_compact(F.array(
            gap(empty, F.col("page"), F.col("page"), "empty page with next link"),
            gap(jump, F.col("next_page"), F.col("page") + 1, "non-sequential page"),
        ))).alias("g"),
    ).select("repo_id", "resource", "g.*")


def gap_report(gaps: DataFrame) -> DataFrame:
    """Gaps per repository and resource with the repository total (resource null)."""
    return gaps.rollup("repo_id", "resource").agg(F.count("*").alias("n")).filter(F.col("repo_id").isNotNull())
