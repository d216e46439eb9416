"""Mixing sources to target weights by the cube method.

A source with target t and size s takes every document t/s times on average.  The
whole part of t/s is taken as it is; the fraction is a sampling problem in which
the number of documents and the number of words shall both come out as planned.
The cube method's flight moves the vector of fractional inclusion probabilities
along the null space of those two constraints until every coordinate but two has
become 0 or 1.  Sources are cut into blocks that fly on their own; what a block
leaves open (two units at most) flies again with the rest of its source, until one
block per source remains.  Its last units (``LAST``, and two of the flight) are the
landing problem, solved by trying all choices.

Rows are units: repeated doc_ids are mixed row by row.  Null text has size 0; null
sources form one source, the last.  Empty sources get target 0; an empty table
gives no rows.  Extra columns are ignored.  Random draws are hashes of (seed,
doc_id), so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm import arrays
from hindcast.llm.scratch import kept

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
BLOCK = 4096
LAST = 12
_NEAR = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the whole text) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for row, buf, offsets in arrays.slices(batch.column("text")):
                size[row : row + len(offsets) - 1] = np.diff(arrays.spans(buf, offsets)[2])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size)], ["doc_id", "source", "size"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return slim.mapInArrow(count, "doc_id long, source string, size long")


def targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n_units and target of each source.

    Shares go by weight; a source stops at ``most`` times its size and the excess is
    shared again by weight.  With sources ordered by (limit / weight) that is one
    level: sources before some point stop at their limits, the others share the rest.
    """
    per = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_units"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    per = per.withColumn("weight", weight).withColumn("limit", limit).withColumn("edge", F.col("limit") / F.col("weight"))
    order = Window.orderBy("edge", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("mass", F.sum("weight").over(everything))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("stopped")) / (F.col("mass") - F.col("gone")))
    )
    # The level counts where it first stays under the source's own edge; later rows share it.
    reached = F.min(F.when(F.col("level") <= F.col("edge"), F.struct("edge", "source", "level"))).over(everything)
    per = per.withColumn("level", reached["level"])
    return per.select("source", "source_size", "n_units", F.least(F.col("level") * F.col("weight"), F.col("limit")).alias("target"))


def _draws(doc_id: np.ndarray, seed: int) -> np.ndarray:
    step = np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = arrays.mixed(doc_id.astype(np.int64).view(np.uint64) + step)
    return arrays.mixed(x).astype(np.float64) / 2.0**64


def flight(x: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move x until at most two coordinates lie strictly between 0 and 1.

    sum(x) and sum(size * x) stay what they were and every coordinate keeps its mean.
    """
    x = x.copy()
    open_units: list[int] = []
    values, weights, draws = x.tolist(), size.tolist(), draw.tolist()
    for unit in range(len(values)):
        if not _NEAR < values[unit] < 1 - _NEAR:
            values[unit] = float(round(values[unit]))
            continue
        open_units.append(unit)
        while len(open_units) == 3:
            i, j, k = open_units
            u = (weights[j] - weights[k], weights[k] - weights[i], weights[i] - weights[j])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            top = max(map(abs, u))
            u = tuple(c / top for c in u)
            ahead = back = float("inf")
            for c, v in zip(u, (values[i], values[j], values[k])):
                if c:
                    ahead, back = min(ahead, ((1 - v) if c > 0 else v) / abs(c)), min(back, (v if c > 0 else (1 - v)) / abs(c))
            step = ahead if draws[unit] * (ahead + back) < back else -back
            still = []
            for c, at in zip(u, open_units):
                v = values[at] + step * c
                if _NEAR < v < 1 - _NEAR:
                    still.append(at)
                else:
                    v = float(round(v))
                values[at] = v
            # The nearest coordinate has landed up to rounding; settle it for good.
            if len(still) == 3:
                nearest = min(still, key=lambda a: min(values[a], 1 - values[a]))
                values[nearest] = float(round(values[nearest]))
                still.remove(nearest)
            open_units = still
    return np.array(values)


def landing(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last open units: the choice that misses words and documents least."""
    x = x.copy()
    at = np.flatnonzero((x > _NEAR) & (x < 1 - _NEAR))
    if len(at):
        choices = (np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1) - x[at]
        scale = max(float(size[at].mean()), 1e-9)
        miss = np.abs(choices @ size[at]) / scale + 0.001 * np.abs(choices.sum(axis=1))
        x[at] = np.rint(choices[int(np.argmin(miss))] + x[at])
    return x


def _fly(last: bool, seed: int):
    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[np.lexsort((group["size"].to_numpy(), _draws(group["doc_id"].fillna(-1).to_numpy(), seed)))]
        x, size = group["x"].to_numpy(float), group["size"].to_numpy(float)
        fliers = max(len(x) - LAST, 0) if last else len(x)
        draw = _draws(group["doc_id"].fillna(-1).to_numpy(), seed + 1)
        x = np.concatenate([flight(x[:fliers], size[:fliers], draw[:fliers]), x[fliers:]])
        return group.assign(x=landing(x, size) if last else x)[COLUMNS]

    return fly


COLUMNS = ["doc_id", "source", "size", "source_size", "target", "n_units", "whole", "x"]
_SCHEMA = "doc_id long, source string, size long, source_size long, target double, n_units long, whole long, x double"


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies x size) of every document."""
    units = kept(sizes(docs), "mix-sizes")
    goal = kept(targets(units, weights, most), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + F.lit(_NEAR))
    other = goal.withColumnRenamed("source", "of")
    units = (
        units.join(other, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("whole", whole)
        .withColumn("x", F.greatest(ratio - whole, F.lit(0.0)))
        .select(*COLUMNS)
    )
    still = goal.agg(F.max("n_units")).first()[0] or 0
    done, level = None, 0
    while still > block:
        blocks = F.ceil(F.col("n_units") / F.lit(block))
        lot = F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), blocks)
        flown = kept(units.groupBy("source", lot.alias("lot")).applyInPandas(_fly(False, seed + 10 * level), _SCHEMA), "mix-flown")
        settled = flown.where(F.col("x").isin(0.0, 1.0))
        done = settled if done is None else done.unionByName(settled)
        units = flown.where(~F.col("x").isin(0.0, 1.0)).withColumn("n_units", F.lit(2) * blocks)
        still, level = 2 * -(-still // block), level + 1
    landed = units.groupBy("source").applyInPandas(_fly(True, seed + 10 * level), _SCHEMA)
    done = landed if done is None else done.unionByName(landed)
    copies = (F.col("whole") + F.col("x").cast("long")).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
