"""Numeric helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where there is nothing to divide by."""
    return F.when(d <= 0, F.lit(0.0)).otherwise(n.cast("double") / d.cast("double"))


def normalized_entropy(counts: Column) -> Column:
    """Entropy of an array of counts over ln(k); 0 for fewer than two non-zero counts."""
    xs = F.filter(counts, lambda c: c > 0)
    total = F.aggregate(xs, F.lit(0.0), lambda a, c: a + c)
    h = F.aggregate(xs, F.lit(0.0), lambda a, c: a - (c / total) * F.log(c / total))
    return F.when(F.size(xs) <= 1, F.lit(0.0)).otherwise(h / F.log(F.size(xs).cast("double")))


def grouped_entropy(p: Column) -> Column:
    """Aggregate form: one row per bucket with its share ``p`` of the group."""
    positive = F.when(p > 0, p)
    k = F.count(positive)
    return F.when(k <= 1, F.lit(0.0)).otherwise(-F.sum(positive * F.log(positive)) / F.log(k.cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def churn_similarity(a: Column, b: Column) -> Column:
    m = F.greatest(a, b)
    return F.when(m <= 0, F.lit(1.0)).otherwise(1.0 - F.abs(a - b) / m)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse maps."""
    return F.aggregate(
        F.map_entries(a), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0))
    )


def overlap_ratio(left: Column, right: Column) -> Column:
    n = F.size(F.array_distinct(left))
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / n)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds from earlier to later, never below zero; null where either is unknown."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.when(micros.isNotNull(), F.greatest(micros / 1e6, F.lit(0.0)))


def zscore(value: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (value - mean) / sd).otherwise(F.lit(0.0))


def response_bucket(events_30d: Column, events_180d: Column) -> Column:
    return (F.when(events_180d <= 0, "none").when(events_30d >= 10, "high")
            .when(events_30d >= 3, "medium").otherwise("low"))


def decayed(weight: Column, age_days: Column, half_life_days: float) -> Column:
    return F.when(age_days >= 0, weight * F.pow(F.lit(0.5), age_days / F.lit(half_life_days))).otherwise(F.lit(0.0))


def parse_time(text: Column) -> Column:
    """ISO text (``Z``, an offset or none, meaning UTC) or epoch seconds as a timestamp."""
    epoch = F.when(text.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(text.cast("double")))
    return F.coalesce(epoch, F.try_to_timestamp(text))


def iso_z(ts: Column) -> Column:
    """ISO text in UTC with a ``Z``; fractions only where there are any."""
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(ts.isNotNull(), F.concat(base, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z")))


def cutoff_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'")
