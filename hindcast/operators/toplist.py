"""Exact top-k members of a group in a trailing window, at many cutoffs at once.

Joining every cutoff with every row of its window is quadratic in the density of
a group.  Here time is cut into periods and these into buckets, and

* in a period, a member has at least what lies in every window that ends there and at
  most what lies in any: who cannot reach the k-th best of the least leaves, with
  the rows that only such members have;
* the sum over the *whole* buckets of a window changes only when a bucket enters
  or leaves, so every member has a step function of the cutoff bucket;
* each step is cut into aligned power-of-two blocks and every block keeps its k
  best members: a bucket finds its best whole-bucket sums in one block per level;
* of the two partly covered buckets at the window's ends, only rows of members that could
  pass the bucket's k-th best sum meet the cutoffs, row by row.

A member outside the k best whole-bucket sums that has no row in the partial
buckets cannot enter the result, so the answer is exact.  Narrower buckets trade
fewer row-by-row pairs for a few more levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.session import stored

#: A window is at most so many periods.
PERIODS = 12
#: Sums of floating values in another order may differ by this share.
_SLACK = 1e-9


def _bucket(ts: Column, width: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / F.lit(width)).cast("bigint")


def _blocks(spans: DataFrame, keep: list[str]) -> DataFrame:
    """Cut the half-open range [_from, _to) of each row into aligned blocks (level, block)."""
    level = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_to") - F.col("_from"))).cast("int"))).alias("level")
    bounds = spans.select(*keep, "_from", "_to", level).selectExpr(
        *keep, "level", "shiftright(_from + shiftleft(1L, level) - 1, level) as _a", "shiftright(_to, level) as _z"
    ).filter("_a < _z and ((_a & 1L) = 1 or (_z & 1L) = 1)")
    both = F.explode(F.expr("array(case when (_a & 1L) = 1 then _a end, case when (_z & 1L) = 1 then _z - 1 end)")).alias("block")
    return bounds.select(*keep, "level", both).filter(F.col("block").isNotNull())


def _reaches(high: str, member: str, exact: bool) -> Column:
    """Whether somebody with at most ``high`` may pass the k-th best (``_least``, ``_last``); null where fewer than k are known."""
    if exact:
        passes = (F.col(high) > F.col("_least")) | ((F.col(high) == F.col("_least")) & (F.col(member) <= F.col("_last")))
    else:
        passes = F.col(high) >= F.col("_least") * (1 - _SLACK)
    return F.col("_least").isNull() | passes


def _kth(rows: DataFrame, group: list[str], total: str, member: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(total).desc(), F.col(member))
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") == k).select(
        *group, F.col(total).alias("_least"), F.col(member).alias("_last"))


def _contending(rows: DataFrame, group: list[str], member: str, k: int, parts: int, exact: bool) -> DataFrame:
    """The rows (with period ``_p``) of members that may be among the k best of some period that sees them."""
    counts = rows.groupBy(*group, member, "_p").agg(F.sum("_v").alias("_v")).repartition(*group, member)
    inside = F.when((F.col("_i") >= 1) & (F.col("_i") < parts), F.col("_v")).otherwise(F.lit(0))
    bounds = (
        counts.select(*group, member, "_p", "_v", F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("_i"))
        .groupBy(*group, member, (F.col("_p") + F.col("_i")).alias("_q"))
        .agg(F.sum(inside).alias("_low"), F.sum("_v").alias("_high"))
    )
    floor = _kth(bounds, [*group, "_q"], "_low", member, k)
    able = bounds.join(floor, [*group, "_q"], "left").filter(_reaches("_high", member, exact))
    needed = able.select(*group, member, F.explode(F.sequence(F.col("_q") - parts, F.col("_q"))).alias("_p")).distinct()
    return rows.join(needed, [*group, member, "_p"], "left_semi")


def windowed_top(
    cutoffs: DataFrame,
    activity: DataFrame,
    group: list[str],
    member: str,
    k: int,
    window_seconds: int,
    bucket_seconds: int = 3600,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """(group…, cutoff, member, total): the k greatest totals of ``value`` in ``[cutoff - window, cutoff]``.

    Ties go to the smaller member.  ``value`` must not be negative.
    """
    if window_seconds % bucket_seconds:
        raise ValueError("the window must be a whole number of buckets")
    n = window_seconds // bucket_seconds
    parts = max(p for p in range(1, PERIODS + 1) if n % p == 0)
    levels = n.bit_length() + 1
    window = F.expr(f"interval '{window_seconds}' second")

    asked = cutoffs.select(*group, "cutoff").distinct().withColumn("_d", _bucket(F.col("cutoff"), bucket_seconds))
    buckets = asked.select(*group, "_d").distinct()
    # Adding up rows of one instant first gives every later step the same four
    # columns to read, so the activity is computed and shuffled once and reused.
    rows = (
        activity.groupBy(*group, member, F.col(ts).alias("_ts")).agg(F.sum(value).alias("_v"))
        .withColumn("_b", _bucket(F.col("_ts"), bucket_seconds))
        .withColumn("_p", F.floor(F.col("_b") / F.lit(n // parts)).cast("bigint"))
    )
    zero = F.lit(0).cast(rows.schema["_v"].dataType)
    exact = rows.schema["_v"].dataType.typeName() not in ("double", "float")
    rows = stored(_contending(rows, group, member, k, parts, exact).drop("_p"))

    # What every member has in the two partial buckets of each cutoff's bucket.
    ends = rows.withColumn("_d", F.explode(F.array(F.col("_b"), F.col("_b") + n)))
    touched = ends.groupBy(*group, member, "_d").agg(F.sum("_v").alias("_most")).join(buckets, [*group, "_d"], "left_semi")

    # Whole-bucket sums as a step function per member; one row per bucket at most.
    moves = (
        rows.groupBy(*group, member, "_b").agg(F.sum("_v").alias("_v"))
        .select(*group, member, F.inline(F.array(
            F.struct((F.col("_b") + 1).alias("_x"), F.col("_v"), F.lit(0).alias("_kind"), zero.alias("_most")),
            F.struct((F.col("_b") + n).alias("_x"), zero.alias("_v"), F.lit(0).alias("_kind"), zero.alias("_most")))))
    )
    lookups = touched.select(*group, member, F.col("_d").alias("_x"), zero.alias("_v"), F.lit(1).alias("_kind"), "_most")
    by_member = Window.partitionBy(*group, member).orderBy("_x")
    steps = stored(
        moves.unionByName(lookups)
        .withColumn("_base", F.sum("_v").over(by_member.rangeBetween(-(n - 2), 0)))
        .withColumn("_to", F.lead("_x").over(by_member))
    )
    edge_base = steps.filter("_kind = 1").select(*group, member, F.col("_x").alias("_d"), "_base", "_most")
    # A look-up inside a step merely cuts it in two.
    spans = steps.filter((F.col("_x") < F.col("_to")) & (F.col("_base") > 0)).withColumnRenamed("_x", "_from")
    in_block = Window.partitionBy(*group, "level", "block").orderBy(F.col("_base").desc(), F.col(member))
    best = (
        _blocks(spans, [*group, member, "_base"])
        .withColumn("_rn", F.row_number().over(in_block))
        .filter(F.col("_rn") <= k)
        .drop("_rn")
    )
    in_bucket = Window.partitionBy(*group, "_d").orderBy(F.col("_base").desc(), F.col(member))
    leading = stored(
        buckets.select(*group, "_d", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
        .withColumn("block", F.expr("shiftright(_d, level)"))
        .join(best, [*group, "level", "block"])
        .groupBy(*group, "_d", member).agg(F.max("_base").alias("_base"))
        .withColumn("_rn", F.row_number().over(in_bucket))
        .filter(F.col("_rn") <= k)
    )
    least = leading.filter(F.col("_rn") == k).select(*group, "_d", F.col("_base").alias("_least"), F.col(member).alias("_last"))
    rivals = edge_base.withColumn("_high", F.col("_base") + F.col("_most")).join(least, [*group, "_d"], "left").filter(
        _reaches("_high", member, exact)).select(*group, member, "_d", "_base")
    from_edges = (
        ends.select(*group, member, "_d", "_ts", "_v").join(rivals, [*group, member, "_d"]).join(asked, [*group, "_d"])
        .filter((F.col("_ts") <= F.col("cutoff")) & (F.col("_ts") >= F.col("cutoff") - window))
        .groupBy(*group, "cutoff", member)
        .agg(F.max("_base").alias("_base"), F.sum("_v").alias("_edge"))
    )
    from_blocks = asked.join(leading, [*group, "_d"]).select(*group, "cutoff", member, "_base", zero.alias("_edge"))

    ranked = Window.partitionBy(*group, "cutoff").orderBy(F.col("total").desc(), F.col(member))
    return (
        from_blocks.unionByName(from_edges)
        .repartition(*group, "cutoff")
        .groupBy(*group, "cutoff", member)
        .agg((F.max("_base") + F.sum("_edge")).alias("total"))
        .withColumn("_rn", F.row_number().over(ranked))
        .filter(F.col("_rn") <= k)
        .drop("_rn")
    )


def windowed_totals(
    asked: DataFrame, activity: DataFrame, keys: list[str], window_seconds: int, at: str = "cutoff",
    ts: str = "ts", value: str = "value", out: str = "total", chunk: str = "MONTH",
) -> DataFrame:
    """Total of ``value`` per key in ``[at - window, at]`` for every asked (key, at).

    Each row adds its value when it enters and takes it off just after it leaves;
    a running total over the merged stream answers all cutoffs in linear time.
    Values should be integers (or exact decimals): they are added and removed.
    """
    from hindcast.operators.ordered import running_total

    window = F.expr(f"interval '{window_seconds}' second")
    zero = F.lit(0).cast(activity.schema[value].dataType)
    enter = activity.select(*keys, F.col(ts).alias("_ts"), F.lit(0).alias("_o"), F.col(value).alias("_v"))
    leave = activity.select(*keys, (F.col(ts) + window).alias("_ts"), F.lit(2).alias("_o"), (-F.col(value)).alias("_v"))
    asks = asked.select(*keys, F.col(at).alias("_ts"), F.lit(1).alias("_o"), zero.alias("_v")).distinct()
    # Rows of one key at one instant are added up first, so a burst is one row.
    moves = enter.unionByName(leave).groupBy(*keys, "_ts", "_o").agg(F.sum("_v").alias("_v"))
    stream = moves.unionByName(asks)
    return (
        running_total(stream, keys, "_ts", "_o", {"_v": out}, chunk)
        .filter("_o = 1")
        .select(*keys, F.col("_ts").alias(at), out)
    )
