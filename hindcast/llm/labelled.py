"""Splits and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(folds: int) -> Column:
    """crc32 of doc_id as text modulo ``folds``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def held_out(folds: int, held: int) -> Column:
    return F.coalesce(remainder(folds) == held, F.lit(False))


def drawn(share: float, seed: int) -> Column:
    """True for about ``share`` of the doc_ids, the same ones in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) < F.lit(int(min(share, 1.0) * (1 << 40)))


def marks(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """doc_id and mark (0 or 1) of the training rows; a doc_id with several rows takes its largest mark."""
    train = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(folds, held))
    return train.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("mark"))
