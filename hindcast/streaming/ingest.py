"""Streaming ingestion: de-duplication and keyed upserts as an append-only log (``ledger`` merges one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hindcast.operators.upsert import event_key, keep_latest


def deduplicate(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival per event key; keys are forgotten ``delay`` after their event time."""
    keyed = events.withColumn("event_key", event_key())
    return keyed.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_key"])


def upsert_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append landed rows to a change log, one partition per micro-batch.

    A batch that is retried after a failure overwrites its own partition, so the
    log holds every row exactly once whatever executors were lost.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The entity table a change log stands for: last write wins per key."""
    log = spark.read.parquet(path)
    return keep_latest(log, keys, ["batch", *order]).drop("batch")
