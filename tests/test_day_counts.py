"""Wide windows from day totals against counting."""

import random
from datetime import date, timedelta

from hindcast.streaming import windows


def test_counts_from_days(spark):
    dice = random.Random(5)
    start = date(2024, 1, 1)
    rows = [(dice.choice(["a", "b", None]), start + timedelta(days=dice.randint(0, 250)), dice.randint(1, 9)) for _ in range(120)]  # repeated days add up
    widths = [1, 30, 90]
    got = {(r.k, r.day): tuple(r[f"n_{w}"] for w in widths) for r in windows.counts_from_days(spark.createDataFrame(rows, "k string, day date, n long"), ["k"], widths).collect()}
    want = {}
    for k, d, _ in rows:
        for w in [0, *widths]:
            at = d + timedelta(days=w)
            want[k, at] = tuple(sum(n for q, e, n in rows if q == k and at - timedelta(days=v) < e <= at) for v in widths)
    assert got == want


def test_counts_of_no_days(spark):
    assert windows.counts_from_days(spark.createDataFrame([], "k string, day date, n long"), ["k"], [7]).count() == 0
