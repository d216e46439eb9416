"""Cohorts: which pull requests, as of which cutoff."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"s": "second", "m": "minute", "h": "hour", "d": "day", "": "second"}


def _delta(policy: str) -> Column | None:
    found = re.fullmatch(r"created_at\+\s*(\d+)([smhd]?)", policy)
    if found:
        return F.expr(f"{int(found[1])} * interval '1' {_UNITS[found[2]]}")
    found = re.fullmatch(r"created_at_plus_minutes:(\d+)", policy)
    if found:
        return F.expr(f"{int(found[1])} * interval '1' minute")
    return None


def with_cutoff(prs: DataFrame, policy: str = "created_at", drafts: DataFrame | None = None) -> DataFrame:
    """Add ``cutoff`` per pull request by a policy.

    ``created_at``, ``created_at+N[s|m|h|d]``, ``created_at_plus_minutes:N`` or
    ``ready_for_review`` (start of the first non-draft interval, else creation).
    """
    if policy == "created_at":
        return prs.withColumn("cutoff", F.col("created_at"))
    delta = _delta(policy)
    if delta is not None:
        return prs.withColumn("cutoff", F.col("created_at") + delta)
    if policy == "ready_for_review":
        if drafts is None:
            raise ValueError("ready_for_review needs draft intervals")
        ready = drafts.filter(~F.col("is_draft")).groupBy("pr_id").agg(F.min("start_ts").alias("_ready"))
        return prs.join(ready, "pr_id", "left").withColumn("cutoff", F.coalesce("_ready", "created_at")).drop("_ready")
    raise ValueError(f"unsupported cutoff policy: {policy}")


def sample_window(prs: DataFrame, start: Column | None, end: Column | None, limit: int | None) -> DataFrame:
    """The first pull requests created in the window, ordered by (created_at, number)."""
    rows = prs.filter(F.col("created_at").isNotNull())
    if start is not None:
        rows = rows.filter(F.col("created_at") >= start)
    if end is not None:
        rows = rows.filter(F.col("created_at") <= end)
    if limit is None:
        return rows
    return rows.orderBy("created_at", "number", "repo_id").limit(limit)


def sample_seeded(prs: DataFrame, seed: int, limit: int) -> DataFrame:
    """A reproducible random sample: the ``limit`` smallest hashes of (seed, repo, number)."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repo_id").cast("string"), F.col("number").cast("string")))
    return prs.withColumn("_draw", draw).orderBy("_draw", "repo_id", "number").limit(limit).drop("_draw")


def horizon(*streams: tuple[DataFrame, str]) -> DataFrame:
    """Latest known time per repository over several tables (repo_id, horizon_max)."""
    parts = [df.groupBy("repo_id").agg(F.max(ts).alias("m")) for df, ts in streams]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("repo_id").agg(F.max("m").alias("horizon_max"))


def stale_cutoffs(cohort: DataFrame, horizons: DataFrame) -> DataFrame:
    """Cohort rows whose cutoff lies after everything that was ingested."""
    return cohort.join(horizons, "repo_id", "left").filter(F.col("cutoff") > F.col("horizon_max"))


def evaluation_order(cohort: DataFrame) -> DataFrame:
    """Pull requests in cutoff order, as a run without future data visits them."""
    return cohort.orderBy("cutoff", "number")


def cohort_hash(cohort: DataFrame) -> DataFrame:
    """One hash per repository over (number, cutoff), independent of row order.

    Rows are hashed alone, then the digests are summed in 32-bit parts: partial
    sums combine before the shuffle and no row list is ever gathered.
    """
    digest = F.sha2(F.concat_ws("|", F.col("number").cast("string"), F.date_format("cutoff", "yyyy-MM-dd'T'HH:mm:ss'Z'")), 256)
    return set_hash(cohort.withColumn("_digest", digest), ["repo_id"], "_digest", "cohort_hash")


def set_hash(rows: DataFrame, keys: list[str], digest: str, out: str) -> DataFrame:
    """Order-independent hash of the digests of each key."""
    parts = [
        F.sum(F.conv(F.substring(F.col(digest), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"_p{i}") for i in range(8)
    ]
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("n"), *parts) if keys else rows.agg(F.count("*").alias("n"), *parts)
    text = F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"_p{i}").cast("string") for i in range(8)])
    return grouped.select(*keys, "n", F.sha2(text, 256).alias(out))
