"""Ordered look-ups that never sort one whole key in one task.

A subject, user or repository may own a third of all rows, so a plain window
over the key would put them into a single task.  Each helper therefore works in
two steps: inside (key, time chunk), and over one summary row per chunk.  A key
then meets at most one row per chunk in any window (days of history, not rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def next_where(
    rows: DataFrame, keys: list[str], ts: str, tie: str, condition: Column, out: str, chunk: str = "DAY"
) -> DataFrame:
    """Add ``out``: (ts, tie) of the first later row of the key where ``condition`` holds."""
    marked = rows.withColumn("_hit", F.when(condition, F.struct(F.col(ts).alias("ts"), F.col(tie).alias("id")))).withColumn(
        "_chunk", F.date_trunc(chunk, F.col(ts))
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(F.col(ts).desc(), F.col(tie).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    marked = marked.withColumn("_near", F.last("_hit", ignorenulls=True).over(inside))
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        marked.groupBy(*keys, "_chunk")
        .agg(F.min("_hit").alias("_first"))
        .withColumn("_far", F.last("_first", ignorenulls=True).over(later))
        .filter(F.col("_far").isNotNull())
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"), "_far")
    )
    on = [marked[k].eqNullSafe(chunks[f"_k_{k}"]) for k in keys] + [marked["_chunk"] == chunks["_k_chunk"]]
    return (
        marked.join(chunks, on, "left")
        .withColumn(out, F.coalesce("_near", "_far"))
        .select(*rows.columns, out)
    )


def last_value_before(
    rows: DataFrame, keys: list[str], ts: str, tie: str, value: Column, out: str, chunk: str = "MONTH"
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the key at or before each row."""
    marked = rows.withColumn("_val", value).withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marked = marked.withColumn("_near", F.last("_val", ignorenulls=True).over(inside))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        marked.filter(F.col("_near").isNotNull())
        .groupBy(*keys, "_chunk")
        .agg(F.max_by("_near", F.struct(ts, tie)).alias("_end"))
    )
    spans = (
        marked.select(*keys, "_chunk").distinct()
        .join(chunks, [*keys, "_chunk"], "left")
        .withColumn("_far", F.last("_end", ignorenulls=True).over(earlier))
        .filter(F.col("_far").isNotNull())
        .select(*keys, "_chunk", "_far")
    )
    return (
        marked.join(spans, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_near", "_far"))
        .select(*rows.columns, out)
    )


def running_total(rows: DataFrame, keys: list[str], ts: str, tie: str, values: dict[str, str], chunk: str = "MONTH",
                  highest: dict[str, str] = {}, lowest: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """Running sums per key, up to and including each row: ``values`` maps column to output name; ``highest`` and ``lowest`` do so for extremes.

    All values share one pass; the helper reads its input twice (rows and chunk
    totals), so it must not be chained once per value.
    """
    marked = rows.withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # column -> (what combines rows, what combines the chunk with those before it)
    edges = [*[(v, out, F.max, F.greatest) for v, out in highest.items()], *[(v, out, F.min, F.least) for v, out in lowest.items()]]
    carried = (
        marked.groupBy(*keys, "_chunk").agg(*[F.sum(v).alias(f"_s_{v}") for v in values], *[of(v).alias(f"_s_{v}") for v, _, of, _ in edges])
        .select(*keys, "_chunk", *[F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_carry_{v}") for v in values],
                *[of(f"_s_{v}").over(earlier).alias(f"_carry_{v}") for v, _, of, _ in edges])
    )
    return (
        marked.select("*", *[F.sum(v).over(inside).alias(f"_in_{v}") for v in values], *[of(v).over(inside).alias(f"_in_{v}") for v, _, of, _ in edges])
        .join(carried, [*keys, "_chunk"])
        .select(*rows.columns, *[
            (F.coalesce(F.col(f"_in_{v}"), F.lit(0)) + F.col(f"_carry_{v}")).alias(out) for v, out in values.items()],
            *[both(f"_in_{v}", f"_carry_{v}").alias(out) for v, out, _, both in edges])
    )
