"""Keyed upserts and insert-or-ignore appends over landed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins per key: the row with the greatest ``order`` survives whole.

    ``max_by`` combines before the shuffle, so a key that is written over and
    over costs one row per map task, not its full history.
    """
    values = [c for c in rows.columns if c not in keys]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), rank).alias("_row"))
        .select(*keys, "_row.*")
        .select(*rows.columns)
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Merge landed rows into an entity table; incoming rows win over stored ones."""
    tagged = current.withColumn("_gen", F.lit(0)).unionByName(
        incoming.withColumn("_gen", F.lit(1)), allowMissingColumns=True
    )
    return keep_latest(tagged, keys, ["_gen", *order]).drop("_gen")


def upsert_files(landed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """File rows keyed per head; rows without a head or a path are not stored."""
    return keep_latest(
        landed.filter(F.col("head_sha").isNotNull() & (F.col("head_sha") != "")
                      & F.col("path").isNotNull() & (F.col("path") != "")),
        keys, order,
    )


def event_key(ts: Column | None = None) -> Column:
    """Natural key of an event: type, subject, time, object and commit.

    A zero object id counts as absent, as it does in the stored history.
    """
    occurred = ts if ts is not None else F.col("occurred_at")
    return F.concat_ws(
        "|",
        F.col("event_type"),
        F.col("subject_type"),
        F.coalesce(F.col("subject_id").cast("string"), F.lit("None")),
        F.date_format(occurred, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
        F.coalesce(F.col("object_type"), F.lit("")),
        F.when(F.col("object_id") != 0, F.col("object_id").cast("string")).otherwise(F.lit("")),
        F.coalesce(F.col("commit_sha"), F.lit("")),
    )


def append_events(events: DataFrame, seq: str) -> DataFrame:
    """Insert-or-ignore by event key: the first row by ``seq`` stays."""
    keyed = events.withColumn("event_key", event_key())
    values = [c for c in keyed.columns if c != "event_key"]
    return (
        keyed.groupBy("event_key")
        .agg(F.min_by(F.struct(*values), F.col(seq)).alias("_row"))
        .select("event_key", "_row.*")
    )
