"""Sliding medians against lists."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hindcast.operators.quantiles import open_medians

T0 = datetime(2020, 1, 1)


@pytest.mark.parametrize("most", [0, 3, 70_000])
def test_medians_of_open_spans(spark, most):
    dice = random.Random(most)
    spans = []
    for _ in range(120):
        a = dice.randint(0, 200)
        spans.append((dice.choice("xxxy"), T0 + timedelta(days=a), T0 + timedelta(days=a + dice.randint(0, 60)), dice.random() < 0.5, dice.choice([0, 1, most, dice.randint(0, most)])))
    asks = [(k, T0 + timedelta(days=d)) for k in "xyz" for d in range(0, 260, 13)]
    table = spark.createDataFrame(spans, "k string, a timestamp_ntz, b timestamp_ntz, closed boolean, v long")
    asked = spark.createDataFrame(asks, "k string, cutoff timestamp_ntz").withColumn("all", F.lit(9))
    table = table.filter("a < b or closed")
    held = lambda k, at: [v for kk, a, b, closed, v in spans if kk == k and (a < b or closed) and a <= at and (at < b or closed and at == b)]
    got = {(r["k"], r["cutoff"]): (r["n"], r["median"]) for r in open_medians(asked, table, ["k"], "a", "b", "closed", "v").collect()}
    assert got == {(k, at): (len(held(k, at)), statistics.median(held(k, at)) if held(k, at) else None) for k, at in asks}
    few = [(k, at) for k, at in asks if len(held(k, at)) <= 9]
    got = {(r["k"], r["cutoff"]): r["median"] for r in open_medians(asked, table, ["k"], "a", "b", "closed", "v", "all").collect()}
    assert all(got[k, at] == statistics.median(held(k, at) + [0] * (9 - len(held(k, at)))) for k, at in few)
