"""Streaming counts over trailing windows, day totals behind wide windows, and the first response to a pull request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_counts(events: DataFrame, keys: list[str], ts: str, width: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events per key in sliding windows, emitted once the watermark has passed them."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def day_totals(events: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """(keys, day, n) of a stream, emitted once the watermark has passed the day: state holds one number per key and open day."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), *keys).agg(F.count("*").alias("n")).select(
        *keys, F.to_date("window.start").alias("day"), "n")


def counts_from_days(days: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """(keys, day, n_<width>...): events of the last ``width`` days, the day included, for every day on which such a count changes.

    A day's total enters on its day and leaves ``width`` days later, so every count is a running
    total of two rows per day and width: linear in days whatever the width.  Days that come in
    several parts add up; a null key is a key of its own.
    """
    every = days.groupBy(*keys, "day").agg(F.sum("n").alias("n"))
    moves = [F.struct(F.lit(0).alias("after"), *[F.col("n").alias(f"n_{w}") for w in widths])]
    moves += [F.struct(F.lit(w).alias("after"), *[(-F.col("n") if v == w else F.lit(0).cast("bigint")).alias(f"n_{v}") for v in widths]) for w in widths]
    moved = every.select(*keys, "day", F.explode(F.array(*moves)).alias("m")).groupBy(*keys, F.date_add("day", F.col("m.after")).alias("day")).agg(
        *[F.sum(f"m.n_{w}").alias(f"n_{w}") for w in widths])
    so_far = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row per day of a key
    return moved.select(*keys, "day", *[F.sum(f"n_{w}").over(so_far).alias(f"n_{w}") for w in widths])


def responses_in_window(prs: DataFrame, reviews: DataFrame, within: str = "60 days", delay: str = "1 day") -> DataFrame:
    """Reviews of other people that follow a pull request within the window.

    Both sides carry watermarks, so the state of a pull request is dropped when
    its window has passed.  ``prs``: (pr_id, author_id, created_at), ``reviews``:
    (pr_id, user_id, submitted_at); the earliest row per pull request answers.
    """
    left = prs.withWatermark("created_at", delay)
    right = reviews.select(F.col("pr_id").alias("r_pr_id"), "user_id", "submitted_at").withWatermark("submitted_at", delay)
    return left.join(right, (F.col("pr_id") == F.col("r_pr_id")) & (F.col("submitted_at") > F.col("created_at"))
                     & (F.col("submitted_at") <= F.col("created_at") + F.expr(f"interval {within}"))
                     & (F.col("user_id") != F.col("author_id"))).drop("r_pr_id")
