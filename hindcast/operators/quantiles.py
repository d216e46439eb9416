"""Exact medians over spans of time, without a list of values in any place.

The median at an asked time is found digit by digit: a value is cut into hexadecimal digits, and in each round
every asked time counts, for the values that share the digits found so far, how many of the spans open at
that time have each next digit.  The counts are differences of running totals (``span_sums``), so a round is linear in
spans and asked times, and keys with millions of values are chunks of time like any others.
The number of rounds is that of the digits of the largest value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.activity import span_sums
from hindcast.session import stored

BITS = 4
_DIGITS = [f"_c{d}" for d in range(1 << BITS)]


def open_medians(asked: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, closed: str, value: str,
                 total: str | None = None, at: str = "cutoff") -> DataFrame:
    """(keys, at, n, median) of the values of all spans that hold the asked time; the median of an even number is the mean of the middle two.

    Values are whole numbers from 0 on.  ``total`` names a column of ``asked``: the number of members, those without a
    span counting as 0.  ``n`` is that number, or the number of open spans; a median of nothing is null.
    """
    spans = stored(spans.select(*keys, F.col(start).alias("_from"), F.col(end).alias("_until"), F.col(closed).alias("_closed"), F.col(value).cast("bigint").alias("_value")))
    own = asked.select(*keys, at, *([F.col(total).cast("bigint").alias("_all")] if total else [])).distinct()
    sums = span_sums(own, spans.withColumn("_one", F.lit(1)), keys, "_from", "_until", "_closed", ["_one"], at)
    every = own.join(sums, [*keys, at]).withColumn("n", F.col("_all") if total else F.col("_one"))
    every = stored(every.withColumn("_zeros", F.col("n") - F.col("_one")))
    most = spans.agg(F.max("_value")).first()[0] or 0
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    state = every.filter("n > 0").select(*keys, at, "_zeros", F.explode(ranks).alias("_rank"))
    small = state.filter("_rank < _zeros").select(*keys, at, F.lit(0).cast("bigint").alias("_node"))
    state = state.filter("_rank >= _zeros").select(*keys, at, (F.col("_rank") - F.col("_zeros")).alias("_rank"), F.lit(0).cast("bigint").alias("_node"))
    for shift in range(BITS * ((max(most.bit_length(), 1) - 1) // BITS), -1, -BITS):
        digit = F.shiftright("_value", shift).bitwiseAND((1 << BITS) - 1)
        node = F.shiftright("_value", shift + BITS) if shift + BITS < 64 else F.lit(0).cast("bigint")
        level = spans.select(*keys, "_from", "_until", "_closed", node.alias("_node"), *[(digit == d).cast("int").alias(c) for d, c in enumerate(_DIGITS)])
        level = level.join(state.select(*keys, "_node").distinct(), [*keys, "_node"], "left_semi")
        counts = span_sums(state.select(*keys, "_node", at), level, [*keys, "_node"], "_from", "_until", "_closed", _DIGITS, at)
        upto = [sum((F.col(c) for c in _DIGITS[1 : d + 1]), F.col(_DIGITS[0])) for d in range(1 << BITS)]
        found = sum(((u <= F.col("_rank")).cast("int") for u in upto[1:]), (upto[0] <= F.col("_rank")).cast("int"))
        before = F.greatest(F.lit(0).cast("bigint"), *[F.when(u <= F.col("_rank"), u) for u in upto])
        state = stored(state.join(counts, [*keys, "_node", at]).select(*keys, at, (F.col("_rank") - before).alias("_rank"), (F.col("_node") * (1 << BITS) + found).alias("_node")))
    middle = state.select(*keys, at, "_node").unionByName(small).groupBy(*keys, at).agg(F.avg("_node").alias("median"))
    return every.select(*keys, at, "n").join(middle, [*keys, at], "left")
